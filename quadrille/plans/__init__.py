"""From text to DataFrames."""
