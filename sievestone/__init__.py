"""sievestone: corpus cleaning, validation and evaluation on Spark DataFrames."""
