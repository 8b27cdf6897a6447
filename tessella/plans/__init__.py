"""From labels to DataFrames."""
