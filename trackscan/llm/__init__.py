"""Operators for training data. Nothing else in trackscan imports this subpackage."""
