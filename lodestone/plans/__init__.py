"""From statement text to outcomes: grammar and execution."""
