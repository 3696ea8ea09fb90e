"""turnstone: meeting-transcript analytics and corpus preparation as Spark jobs."""
