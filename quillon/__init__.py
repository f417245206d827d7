"""quillon: a Spark-native engine for analysing and compacting conversation histories."""
