"""Relational operators: merging, excess marks, hourly usage, cubes."""
