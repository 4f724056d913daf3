"""Operators for training-data preparation: one module per operator, queries and SQL twins beside them."""
