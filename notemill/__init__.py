"""notemill: hybrid retrieval and analytics over large collections of short text notes, on Spark DataFrames."""
