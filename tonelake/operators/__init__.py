"""Operators over parameter, trial, measurement and signal tables; each takes and returns DataFrames."""
