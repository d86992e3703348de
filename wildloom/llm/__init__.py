"""Operators for training text."""
