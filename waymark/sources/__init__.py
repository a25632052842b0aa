"""Readers of location exports, and text forms of the results."""
