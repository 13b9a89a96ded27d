"""Analytics of competition records on Spark."""
