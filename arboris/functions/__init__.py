"""Column functions and the small driver-side tables behind them."""
