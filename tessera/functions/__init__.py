"""Column functions, prefix sums and element kernels."""
