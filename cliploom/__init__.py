"""Clip discovery and text scoring over whole corpora of transcripts, as Spark DataFrame jobs."""
