"""Grid, document, log and record operators over DataFrames."""
