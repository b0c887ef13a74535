"""Batch jobs on Spark that prepare hourly road-sensor data and training text."""
