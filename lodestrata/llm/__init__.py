"""Training-data operators: ten independent modules, joined only by `common`."""
