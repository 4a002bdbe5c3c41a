"""plumbline: PySpark-native judging and curating of candidate SQL and training text."""
