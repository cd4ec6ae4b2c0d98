"""A PySpark-native analytics library for message-threat data and text corpora."""
