"""kinweave: record linkage and entity resolution as Spark DataFrame programs."""

__version__ = "0.1.0"
