"""Column expressions for points, segments and triangles."""
