"""Point-in-time analytics on daily instrument panels, as Spark DataFrame jobs."""
