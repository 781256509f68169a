"""The registered queries over the given tables, and the same in SQL for comparison."""
