"""Relational and spatial operators over frames of points and wireframes."""
