"""Time-series research analytics as DataFrame operators on Spark."""
