"""Signals of recordings that are still running, as streams."""
