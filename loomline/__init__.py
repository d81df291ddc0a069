"""A news-intelligence and training-data engine built on Spark DataFrames."""
