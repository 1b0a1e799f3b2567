"""Operators that change a table: imports, deletions, retention, repair."""
