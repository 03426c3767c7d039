"""gossamer: Spark-native web-page analytics."""
