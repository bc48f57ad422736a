"""Reduction of single-crystal diffuse scattering as Spark DataFrame operators."""
