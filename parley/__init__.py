"""parley: conversation and meeting analytics expressed as Spark DataFrames."""
