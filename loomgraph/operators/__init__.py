"""Operators over relations of term shapes."""
