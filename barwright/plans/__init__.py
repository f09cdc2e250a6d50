"""Jobs composed from the operators: training, meta-labelling, grids and backtests."""
