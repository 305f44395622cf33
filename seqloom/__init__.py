"""seqloom: frequent approximate pattern discovery on Spark DataFrames."""
