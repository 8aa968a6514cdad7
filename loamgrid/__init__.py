"""A Spark-native geospatial analytics engine."""
