"""Record linkage on Spark DataFrames: from source rows to published golden records."""
