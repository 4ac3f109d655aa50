"""Chains of operators over the driver tables, with their SQL counterparts."""
