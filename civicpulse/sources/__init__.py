"""Readers of landed files, and the table writer."""
