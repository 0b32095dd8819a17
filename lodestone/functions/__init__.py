"""Types, literals and conditions as columns."""
