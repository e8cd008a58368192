"""The analyses, composed from operators. All take and return DataFrames."""
