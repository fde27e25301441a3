"""weftline: Spark-native operators for tool-calling agent datasets."""
