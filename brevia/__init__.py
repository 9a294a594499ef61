"""brevia: conversation and document compaction on Spark DataFrames."""
