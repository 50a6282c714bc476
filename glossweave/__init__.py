"""Spark-native curation of bilingual text tables."""
