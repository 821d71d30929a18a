"""Structured Streaming forms: the extracts, the contact set and the B13 totals."""
