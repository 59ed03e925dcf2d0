"""Operators for the text and labels of training data. Nothing outside this folder imports it."""
