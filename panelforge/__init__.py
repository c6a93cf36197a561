"""Panel features, drift audits and tail-aware scoring on Spark DataFrames."""
