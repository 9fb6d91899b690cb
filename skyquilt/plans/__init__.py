"""plans of the operating-picture engine."""
