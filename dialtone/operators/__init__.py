"""Table-level operators the report plans are put together from."""
