"""Panel analytics on Spark: bars, posts, features, forecasts and their evaluation."""
