"""Incremental samples over streams."""
