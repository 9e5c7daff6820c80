"""quern: a Spark-native engine for task-conditioned compression of tool output and for analytics over its traces."""
