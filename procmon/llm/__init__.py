"""Training-data operators: each module is one operator; nothing outside this package imports it."""
