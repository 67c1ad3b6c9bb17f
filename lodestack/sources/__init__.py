"""Readers that make fact tables of files and tables, and writers of results."""
