"""Spreadsheet functions as Column and aggregate builders."""
