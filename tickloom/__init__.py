"""Tick and OHLC analytics as DataFrame transformations, for batch tables and streams."""
