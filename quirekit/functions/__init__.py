"""Column functions and vectorized scalar kernels."""
