"""lexiweft: a Spark-native engine for code and text relations."""
