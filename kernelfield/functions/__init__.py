"""Functions of the particle-to-continuum engine."""
