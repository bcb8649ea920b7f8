"""cadence: a PySpark-native engine for timelines, content metrics and corpus preparation."""
