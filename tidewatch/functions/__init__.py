"""Forecast metrics as aggregate columns, and small numeric functions."""
