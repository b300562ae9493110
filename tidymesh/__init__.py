"""Tidy data verbs and model analysis under uncertainty, on Spark."""
