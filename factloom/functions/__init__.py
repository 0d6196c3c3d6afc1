"""functions of the evidence engine."""
