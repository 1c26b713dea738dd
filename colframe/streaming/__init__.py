"""Recorded steps, and time windows over tables or streams."""
