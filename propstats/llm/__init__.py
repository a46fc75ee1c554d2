"""Operators for preparing training text, and the registered queries over them."""
