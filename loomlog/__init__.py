"""loomlog: command-log analytics and training-data preparation on Spark.

Every operator takes and returns DataFrames; nothing here collects a table.
"""
