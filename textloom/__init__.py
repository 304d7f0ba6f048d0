"""A Spark-native engine for building, labelling, splitting and evaluating text corpora."""
