"""Camera geometry and image reprojection on Spark DataFrames."""

__version__ = "0.3.0"
