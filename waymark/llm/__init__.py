"""Operators for preparing large training corpora. Nothing outside imports this."""
