"""quillspark: Spark-native analytics over repository-documentation corpora."""
