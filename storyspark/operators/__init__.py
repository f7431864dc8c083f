"""Story, feed, retrieval and analytics operators: functions from DataFrames to DataFrames."""
