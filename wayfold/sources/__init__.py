"""Readers: map files, text layers and the shared test tables."""
