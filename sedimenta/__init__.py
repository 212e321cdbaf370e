"""Analytics over evolving document and code collections, on Spark DataFrames."""
