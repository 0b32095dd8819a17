"""A PySpark-native table engine: a small statement language over versioned Parquet snapshots."""
