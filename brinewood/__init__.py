"""Brinewood: a DataFrame-native engine that turns semi-structured documents into reconciled records."""
