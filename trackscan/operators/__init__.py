"""trackscan operators."""
