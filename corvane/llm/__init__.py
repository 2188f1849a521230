"""Operators of a training-data pipeline over web-scale text. Nothing else in the library imports this."""
