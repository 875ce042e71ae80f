"""tripweave: origin-destination trip analytics and count forecasting on Spark DataFrames."""
