"""A Spark-native engine for volumes, regions, histograms and bags of instances."""
