"""Layers put together over one input folder, and the catalogue of named queries."""
