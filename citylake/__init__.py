"""citylake: city-scale spatial and indicator analytics on Spark DataFrames."""

__version__ = "0.1.0"
