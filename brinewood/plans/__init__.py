"""Plans of the record engine."""
