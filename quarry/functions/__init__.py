"""Shared Column expressions and skew-safe building blocks."""
