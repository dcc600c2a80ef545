"""salvora: a Spark-native engine for document salvage, table reconstruction and corpus analytics."""
