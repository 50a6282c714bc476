"""Query catalog and jobs."""
