"""Spark-native market-data analytics."""
