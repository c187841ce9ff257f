"""Subpackage formatting."""
