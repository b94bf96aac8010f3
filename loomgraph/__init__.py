"""Evidence-graph analytics on Spark: claims with evidence, queried as DataFrames."""
