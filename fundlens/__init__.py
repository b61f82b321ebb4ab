"""fundlens: public-works fund monitoring on Spark DataFrames."""
