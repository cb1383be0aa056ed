"""Publication analytics on Spark: packages, coordinates, positions, text, links and packages out again, as DataFrame operators."""

__version__ = "0.1.0"
