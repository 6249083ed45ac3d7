"""textloom: document-semantics analytics on PySpark DataFrames."""
