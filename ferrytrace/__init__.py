"""Filter, deliver and measure streams of readings with Spark DataFrames."""

__version__ = "0.1.0"
