"""quire: a Spark-native engine for reviewing large technical documents as data."""
