"""Spark-native risk decisioning over transactional history."""
