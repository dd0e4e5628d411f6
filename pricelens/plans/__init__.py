"""Composed plans: pipelines (Z1-Z5) and the registry of checkable queries."""
