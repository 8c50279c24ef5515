"""tablewright: data-quality and cleaning engine on Spark DataFrames."""

__version__ = "0.1.0"
