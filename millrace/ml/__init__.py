"""Feature transformers, splits, metrics and models."""
