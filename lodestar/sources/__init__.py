"""Tables of files."""
