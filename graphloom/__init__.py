"""A property-graph analytics engine on Spark DataFrames."""
