"""Reading, reshaping and writing tables."""
