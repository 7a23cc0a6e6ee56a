"""Training-data operators: one module for each, their shared helpers, and ``queries`` with what the driver runs."""
