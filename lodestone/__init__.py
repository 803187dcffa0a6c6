"""lodestone: medallion-style analytics and training-data jobs, written for Spark."""
