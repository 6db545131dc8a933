"""Vessel-traffic analytics on Spark DataFrames and streams."""
