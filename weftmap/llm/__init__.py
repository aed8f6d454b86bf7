"""Training-data operators: ten pieces of a text-corpus pipeline on Spark.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
