"""flowlark: packet and flow analytics as Spark DataFrames."""
