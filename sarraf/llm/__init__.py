"""Operators of the problems tagged llm; nothing outside this package imports it."""
