"""Stored tables, CSV in and out."""
