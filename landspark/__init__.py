"""A PySpark-native analytics engine for finding under-priced land."""
