"""Text operators over Columns and DataFrames."""
