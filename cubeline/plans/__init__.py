"""Plans over the tables: usage queries, their presentation, and incremental runs."""
