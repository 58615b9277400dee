"""Market-data analytics on Spark: ticks, bars, news, factors, predictions, metrics."""
