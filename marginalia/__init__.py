"""Analytics over large personal text catalogs, as Spark DataFrames."""
