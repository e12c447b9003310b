"""Numerical kernels on small dense arrays; plans call them inside grouped pandas functions."""
