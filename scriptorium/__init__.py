"""scriptorium: a PySpark-native engine for versioned text corpora, study notes and ingestion queues."""
