"""PySpark-native analytics for entity time series, vectors and rasters."""
