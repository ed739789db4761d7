"""Training-data operators. Each module is one operator; ``queries`` registers them over the given tables."""
