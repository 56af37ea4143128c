"""Zero-filled completeness counts over time-series tables, as Spark DataFrames."""
