"""corymb: specimen phenotyping and divergence analytics as Spark plans."""

__version__ = "0.1.0"
