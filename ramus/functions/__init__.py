"""Column expressions: vectors, boxes, balls and planar geometry."""
