"""Lectern: structuring, segmenting and timing large document collections for listening, as Spark jobs."""
