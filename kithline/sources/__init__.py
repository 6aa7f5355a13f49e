"""Readers of files, feeds and registries."""
