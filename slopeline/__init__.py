"""slopeline: landslide and flood early-warning analytics on Spark DataFrames."""
