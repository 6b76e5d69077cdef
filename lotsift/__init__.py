"""Lot and zone analytics on Spark DataFrames: overlay, text matching, ranking, reports, ledgers."""
