"""Clickstream analytics as Spark DataFrame operators.

Every operator takes prepared DataFrames and returns a DataFrame; nothing is
collected on the driver.  See README.md for the map from tasks to modules.
"""
