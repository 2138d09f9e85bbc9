"""dayweave: daily time-series analytics for tracker and diary data on Spark."""

__version__ = "0.1.0"
