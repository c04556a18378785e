"""Readers and writers: records, saved graphs, results."""
