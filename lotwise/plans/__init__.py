"""Reports put together from operators, and the query catalogue."""
