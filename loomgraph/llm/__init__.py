"""Training-data operators: corpus and vector components built on Spark.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, leaves unrelated columns alone and documents what it does with
nulls, empty texts, ties and repeated rows.
"""
