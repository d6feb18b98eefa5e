"""Operators for preparing training text. Nothing else in this library imports them."""
