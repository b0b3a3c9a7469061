"""The same transformations as continuous queries."""
