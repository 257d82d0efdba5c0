"""Readers, writers and benchmark-table views."""
