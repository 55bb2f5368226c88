"""Whole reports composed from operators, and the queries over the test tables."""
