"""Report and look-up operators: DataFrames in, one lazy DataFrame out."""
