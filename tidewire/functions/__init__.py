"""Part of the library; see README.md for the layout."""
