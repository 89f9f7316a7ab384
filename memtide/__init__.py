"""memtide: Spark-native analytics over memory-card images and save files."""
