"""Spark-native analytics for news feeds, market series and editorial evidence."""
