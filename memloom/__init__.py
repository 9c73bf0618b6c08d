"""Memory records of AI-agent fleets as PySpark DataFrames."""
