"""A PySpark-native engine for evidence drawn from social-media dumps."""
