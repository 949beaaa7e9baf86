"""corpusflow: Spark DataFrame operators for building and querying legal text corpora."""
