"""Record linkage on Spark: normalise, block, compare, score, decide and evaluate with DataFrames."""
