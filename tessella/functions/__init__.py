"""Column expressions without Python on the executors."""
