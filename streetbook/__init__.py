"""Business-directory analytics as Spark DataFrame jobs."""
