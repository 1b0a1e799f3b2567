"""Import sources: CSV, rows in memory, columnar frames, and any DataFrame. Each yields typed columns and _row_no."""
