"""careline: treatment outcome and medication adherence analytics on Spark.

Every operator is a plain function from DataFrames to a DataFrame. Nothing is
collected to the driver and no operator calls an action; only the report sinks
write.
"""
