"""Market-data analytics on Spark DataFrames: candle series, backtests, order books and their streaming twins."""
