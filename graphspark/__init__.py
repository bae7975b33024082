"""graphspark: property-graph queries and data processing on Spark DataFrames."""
