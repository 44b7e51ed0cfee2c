"""Particle-to-continuum analytics expressed as Spark DataFrame plans."""
