"""sources of the operating-picture engine."""
