"""Spark-native analytics for personal spending data: purchases, receipts and reports."""
