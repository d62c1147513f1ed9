"""Place, text-retrieval and weather-aware trip analytics as Spark DataFrame jobs."""
