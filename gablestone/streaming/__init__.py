"""Event state, in batch and as streams."""
