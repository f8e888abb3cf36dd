"""Document structuring, reading analytics and training-data preparation on Spark."""
