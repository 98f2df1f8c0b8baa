"""weekpanel: weekly entity panels on Spark (prices, statements, news, models, star schema)."""
