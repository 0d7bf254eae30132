"""vaultframe: a Spark-native engine for ranked retrieval and analytics over long-lived memory corpora."""
