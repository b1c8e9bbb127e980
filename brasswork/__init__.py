"""brasswork: a PySpark-native engine that refines raw documents into governed records."""
