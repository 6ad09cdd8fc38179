"""Spark-native recommender pre-training and transfer analytics."""
