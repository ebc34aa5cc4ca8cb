"""siltstone: a Spark-native engine for planning documents and corpora."""
