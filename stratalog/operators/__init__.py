"""Operators over fact tables."""
