"""Shared plan helpers and the query catalogue."""
