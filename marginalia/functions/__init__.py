"""Scalar expressions: text, tokens, geometry."""
