"""A PySpark-native engine for source-code corpora: parse, index, relate and query them as DataFrames."""
