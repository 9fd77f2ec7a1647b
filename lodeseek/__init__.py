"""PySpark-native search and analytics engine."""
