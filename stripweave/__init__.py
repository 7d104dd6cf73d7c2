"""DataFrame operators for ordered, interval and layout data on Spark."""
