"""Market-research analytics over candle tables, built on Spark DataFrames.

Every operator takes a long candle table holding all symbols and timeframes at once and
returns a DataFrame; nothing is collected to the driver.
"""
