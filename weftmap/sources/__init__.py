"""Readers and writers: pixels, text formats, result tables, manifests."""
