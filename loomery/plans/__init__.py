"""Multi-step plans: loops over DataFrames with staged state."""
