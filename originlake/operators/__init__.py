"""Operators on observations and history."""
