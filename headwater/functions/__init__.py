"""Column functions over vectors and statistics over DataFrames."""
