"""Features, signals, backtests, validation, regimes, gates, store and search."""
