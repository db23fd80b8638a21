"""Column expressions: planar geometry and the density colour ramp."""
