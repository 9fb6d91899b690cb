"""streaming of the operating-picture engine."""
