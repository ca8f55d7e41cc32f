"""folioframe: manuscript analytics as Spark DataFrames."""
