"""Graph algorithms: iterative DataFrame loops and grouped kernels."""
