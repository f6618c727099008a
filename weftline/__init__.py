"""Task-to-code retrieval analytics and corpus data processing on Spark."""
