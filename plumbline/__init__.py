"""Spark-first building blocks for evaluating retrieval-augmented question answering."""
