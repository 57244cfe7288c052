"""Catalogue analytics on Spark: typed file tables, duplicates, rules, reports and plans as DataFrames."""
