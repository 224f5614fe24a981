"""wavelake: radio-packet analytics expressed as Spark DataFrames."""
