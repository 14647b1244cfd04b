"""Reports and whole analyses, composed from the operators."""
