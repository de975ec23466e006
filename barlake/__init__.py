"""barlake: market-screening and validation operators expressed as Spark DataFrames."""
