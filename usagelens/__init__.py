"""Usage statistics for AI-gateway request logs, expressed as Spark DataFrames."""
