"""Factor definitions and the evaluation plans built from the operators."""
