"""Sources of the record engine."""
