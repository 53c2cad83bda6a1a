"""Reading, writing and replacing tables."""
