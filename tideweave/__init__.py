"""tideweave: attributed networks and surveillance series on Spark DataFrames."""

__version__ = "0.1.0"
