"""Analyzers, edits and list algebra over the fact tables."""
