"""Lexing and parsing of T-SQL text."""
