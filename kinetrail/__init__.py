"""Analytics of particles that move between discrete sites in a periodic cell, on Spark DataFrames."""
