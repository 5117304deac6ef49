"""Column functions: arithmetic of programs' values, lattice aggregates, and test statistics."""
