"""Readers: JSON payloads, fixtures, documents of several formats, catalogues and profiles."""
