"""Readers and writers for provider exports and canonical tables."""
