"""fathomlake: Spark-native analytics for financial data lakes."""
