"""Operators for training-data work on language models; nothing outside this folder imports it."""
