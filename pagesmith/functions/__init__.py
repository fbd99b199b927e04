"""See README.md for the operator list."""
