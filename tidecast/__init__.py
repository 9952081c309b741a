"""PySpark-native probabilistic time-series forecasting."""

__version__ = "0.1.0"
