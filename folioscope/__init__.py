"""Folioscope: corpus analytics on Spark DataFrames."""
