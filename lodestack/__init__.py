"""Code-corpus analytics on Spark: corpora, facts, findings and edits as DataFrames."""
