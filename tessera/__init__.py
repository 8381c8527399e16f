"""tessera: Spark-native curation of media corpora and evaluation of binary classifiers."""
