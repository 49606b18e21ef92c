"""A PySpark-native engine for studying how a multilingual corpus frames an event."""
