"""Rendering and whole runs over a repository."""
