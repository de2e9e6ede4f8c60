"""chronodiff: change detection and change-history queries on Spark DataFrames."""
