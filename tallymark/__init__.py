"""A Spark-native engine for public ballot-measure records."""
