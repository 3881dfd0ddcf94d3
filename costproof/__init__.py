"""Cost and quality analytics for recorded language-model traffic, as plain Spark jobs."""

__version__ = "0.1.0"
