"""scanlake: a Spark-native analytics engine for scan-level LC-MS data."""
