"""trackscan streaming."""
