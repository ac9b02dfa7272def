"""Revision analytics on Spark: corrected essays -> token labels -> word scores."""

__all__ = ["session", "constants"]
