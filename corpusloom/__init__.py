"""Document-corpus analytics on PySpark DataFrames."""
