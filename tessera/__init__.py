"""tessera: a Spark-native engine for project knowledge, code graphs and text corpora."""
