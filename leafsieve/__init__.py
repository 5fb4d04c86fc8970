"""leafsieve: repeated-item analytics on Spark DataFrames."""
