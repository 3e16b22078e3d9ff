"""A raster data engine on Spark: encoded images and their pixels as DataFrames."""
