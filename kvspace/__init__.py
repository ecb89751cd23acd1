"""Space forensics for versioned key-value snapshots, as PySpark DataFrame operators."""
