"""Training-data operators: one module for each, see README."""
