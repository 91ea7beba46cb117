"""Column functions: text, prices, time and rules."""
