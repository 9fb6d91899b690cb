"""functions of the operating-picture engine."""
