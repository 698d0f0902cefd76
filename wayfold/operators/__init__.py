"""Relational and iterative operators on map elements and road graphs."""
