"""Readers, writers and the shaping of raw input."""
