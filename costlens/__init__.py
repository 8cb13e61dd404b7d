"""Spark-native cost analytics for language-model request traffic."""
