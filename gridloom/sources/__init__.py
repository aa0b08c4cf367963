"""Readers and writers for delimited, office, text and log files."""
