"""Wayfold: mobile-mapping and sensor-fusion analytics as ordinary Spark DataFrames."""
