"""Ovelia: overlap-aware analytics for imbalanced labelled tables, on Spark DataFrames."""
