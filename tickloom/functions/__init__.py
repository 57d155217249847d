"""Column builders: rolling windows, recursive series, ladders and safe arithmetic."""
