"""Analysis of large T-SQL script collections on Spark."""

__version__ = "0.1.0"
