"""Definitions read from Catalyst plans."""
