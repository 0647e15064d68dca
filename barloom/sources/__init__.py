"""Readers and writers of tick and bar tables."""
