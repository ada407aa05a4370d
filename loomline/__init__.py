"""loomline: a PySpark-native analytics engine for streams of articles and events."""
