"""Analytics over evidence-labelled, bitemporal property graphs, on Spark DataFrames."""
