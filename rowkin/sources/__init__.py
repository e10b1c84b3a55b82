"""Reading source tables and writing layered, versioned tables."""
