"""Filter design and numeric kernels in NumPy."""
