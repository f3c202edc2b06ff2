"""marketspark: marketplace analytics as lazy PySpark DataFrame jobs."""
