"""Readers and schemas of the five input tables."""
