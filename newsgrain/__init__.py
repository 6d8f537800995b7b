"""Set-oriented news-intelligence operators on Spark DataFrames."""
