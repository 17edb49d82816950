"""Options-volatility analytics on Spark."""
