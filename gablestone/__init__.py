"""Analytics over airborne point clouds and building footprints, on Spark DataFrames."""
