"""veilspan: find, replace and restore sensitive text as Spark DataFrames."""

__version__ = "0.1.0"
