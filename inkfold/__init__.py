"""A PySpark-native engine for building, auditing, scoring and replaying short-text correction corpora."""
