"""Spark-native metric engine: layered warehouse metrics and the facts about their definitions."""
