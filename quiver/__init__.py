"""quiver: property-graph queries and table processing on Spark DataFrames."""
