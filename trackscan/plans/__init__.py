"""trackscan plans."""
