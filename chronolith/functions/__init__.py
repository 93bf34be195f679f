"""Column functions and vocabularies of the observation table."""
