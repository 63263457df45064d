"""NumPy kernels that run inside grouped Arrow operators."""
