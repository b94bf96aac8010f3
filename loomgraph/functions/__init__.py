"""Column functions of the evidence model."""
