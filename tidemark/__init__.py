"""Point-in-time analytics on Spark: declarative DataFrame operators for time series and text research."""
