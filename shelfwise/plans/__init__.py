"""Complete plans: the pipeline, the report, analytical reads, the query registry."""
