"""nearvote: labelled nearest-neighbour vote analytics on Spark DataFrames."""
