"""Time-series drift and forecast evaluation on Spark."""
