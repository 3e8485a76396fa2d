"""A PySpark-native engine for typed property graphs stored as DataFrames."""
