"""Frame-indexed measurement data on Spark: inventories, geometry, time series."""
