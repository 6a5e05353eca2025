"""Spark-native market-bar analytics: loading, features, forecasting, exploration."""
