"""trackscan functions."""
