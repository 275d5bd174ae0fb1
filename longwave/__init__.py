"""longwave: a Spark-native engine for slicing, describing and comparing long ordered signals."""
