"""loamline: change-history, source-tree and corpus analytics expressed as Spark DataFrames."""
