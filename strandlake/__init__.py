"""strandlake: read-signal analytics and corpus preparation as PySpark DataFrame jobs."""
