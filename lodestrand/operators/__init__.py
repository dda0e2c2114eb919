"""Operators over the engine's tables; every one takes and returns DataFrames."""
