"""Staged tables and named queries."""
