"""skylathe: a Spark-native engine for maintenance-log knowledge graphs and corpus preparation."""
