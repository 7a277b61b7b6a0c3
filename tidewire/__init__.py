"""Packet and traffic analytics on Spark: captures, filters, reports, series and sessions as DataFrames."""

__version__ = "0.1.0"
