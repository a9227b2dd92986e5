"""Operators for preparing training text: each module is one operator, usable by itself on any DataFrame."""
