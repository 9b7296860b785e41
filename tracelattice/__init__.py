"""Search distributed traces by shape with Spark DataFrames."""
