"""Event-aligned statistical modelling on Spark DataFrames."""
