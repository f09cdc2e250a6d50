"""DataFrame-in, DataFrame-out operators keyed by symbol."""
