"""The layered e-commerce warehouse: simulated sources, models, checks and dashboard."""
