"""quillon: set-at-a-time relationship-graph permission queries on Spark DataFrames."""
