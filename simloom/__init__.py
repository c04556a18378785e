"""simloom: similarity graphs and entity alignment on Spark DataFrames."""
