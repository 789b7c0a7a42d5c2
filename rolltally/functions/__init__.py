"""Column-level functions: every one takes and returns Column expressions."""
