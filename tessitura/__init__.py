"""tessitura: Spark-native analytics over framewise time series, and corpus preparation."""
