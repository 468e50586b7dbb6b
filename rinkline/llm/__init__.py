"""Operators of the training-data problems tagged llm; nothing outside this package imports it."""
