"""The queries run on the given tables, and the same in SQL."""
