"""Palimpsest: dated, geolocated evidence analytics on Spark DataFrames."""
