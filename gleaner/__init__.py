"""A Spark-native engine that audits web content: extraction, scored checks, composite scores and run history as DataFrames."""
