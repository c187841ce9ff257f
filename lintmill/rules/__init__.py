"""Subpackage rules."""
