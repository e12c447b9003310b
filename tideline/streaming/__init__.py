"""Streams of vintage rows, kept up to date as revisions arrive."""
