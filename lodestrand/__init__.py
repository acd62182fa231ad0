"""Spark-first engine for ranking, fusing, windowing and scoring time-anchored evidence."""
