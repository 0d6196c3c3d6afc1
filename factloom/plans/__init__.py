"""plans of the evidence engine."""
