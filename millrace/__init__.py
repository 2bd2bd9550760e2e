"""millrace: a Spark-native engine for budgeted selection, accounting and evaluation of training data."""
