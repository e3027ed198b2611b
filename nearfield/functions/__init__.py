"""Column builders and numpy kernels: vectors, distances, hash families."""
