"""Import of matrices and datasets of named tables."""
