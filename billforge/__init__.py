"""billforge: billing-document processing expressed as Spark DataFrame jobs."""
