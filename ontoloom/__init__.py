"""ontoloom: text-to-ontology analytics on Spark DataFrames."""
