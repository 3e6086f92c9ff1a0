"""Symbols, imports, calls and skeletons of source texts. One pass over a text gives all of them."""
