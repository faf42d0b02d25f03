"""Reading, writing and the fixed dimensions."""
