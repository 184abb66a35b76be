"""Structured Streaming forms of folds."""
