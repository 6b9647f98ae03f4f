"""Registered queries and the jobs behind them."""
