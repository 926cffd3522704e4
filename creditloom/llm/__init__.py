"""Operators for preparing training data: filtering, de-duplication, tokenising, packing, search."""
