"""A PySpark-native engine for content-addressed packing of data and analytics on its bytes."""
