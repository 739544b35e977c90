"""Readers and writers: question files, image listings, registries, reports."""
