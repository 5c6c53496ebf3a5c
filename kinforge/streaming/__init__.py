"""Incremental scoring of new master records against a static index."""
