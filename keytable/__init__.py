"""keytable: keyed tables as lazy Spark DataFrames."""
