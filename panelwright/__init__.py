"""Panel analytics on Spark DataFrames: features known at an origin, walk-forward scores, ranked lists."""
