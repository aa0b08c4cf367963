"""Gridloom: spreadsheet, document and log analytics on Spark DataFrames."""
