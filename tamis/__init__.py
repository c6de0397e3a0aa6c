"""tamis: a PySpark engine that queries source text with declarative rules."""

__version__ = "0.1.0"
