"""Readers and writers of clouds and wireframes."""
