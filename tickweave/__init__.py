"""tickweave: factor expressions, research-corpus analytics and data repair on Spark DataFrames."""

__version__ = "0.1.0"
