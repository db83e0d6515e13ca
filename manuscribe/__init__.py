"""Analytics of prose at corpus scale on Spark."""
