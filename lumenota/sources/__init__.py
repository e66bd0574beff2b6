"""Readers and writers of the document, run, manifest, label and price tables."""
