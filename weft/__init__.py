"""weft: temporal, typed graph analytics expressed as Spark DataFrames."""
