"""Reports and the registry of named queries with their reference SQL."""
