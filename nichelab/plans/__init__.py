"""Composite jobs: model-ready tables, environment extraction, training, risk maps."""
