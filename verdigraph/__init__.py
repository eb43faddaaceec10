"""Warning-context and verdict engine on Spark."""

__version__ = "0.1.0"
