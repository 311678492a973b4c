"""Scalar functions of messages."""
