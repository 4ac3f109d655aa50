"""Operators for preparing training text: one module per operator, one for their queries."""
