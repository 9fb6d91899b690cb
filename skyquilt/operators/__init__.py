"""operators of the operating-picture engine."""
