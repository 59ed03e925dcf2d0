"""Registered queries, by module."""
