"""Evaluation analytics for generated speech and its transcripts, as Spark DataFrame plans."""
