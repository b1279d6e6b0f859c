"""A Spark-native engine for storing and searching conversational memory."""
