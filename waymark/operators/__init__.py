"""operators of the trajectory engine."""
