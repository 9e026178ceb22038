"""Reference-data curation, versioning and rule validation on Spark DataFrames."""
