"""trackscan sources."""
