"""Streaming search: queries arrive as a stream, the data and its index stay tables."""
