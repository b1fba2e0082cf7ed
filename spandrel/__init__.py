"""Spandrel: Spark-native analytics for document extraction and document question answering."""
