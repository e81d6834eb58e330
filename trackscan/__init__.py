"""trackscan: a Spark-first engine for sequences of 3-D point-cloud frames.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans the work.
"""
