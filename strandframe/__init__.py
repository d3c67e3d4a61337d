"""Spark-first analytics for sequence alignments, sequence graphs and intervals."""
