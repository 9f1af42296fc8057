"""Readers of report logs, sentence logs and side tables."""
