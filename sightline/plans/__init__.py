"""Read views, report tables and run documents, composed of operators."""
