"""Readers and writers of logger, biomet and dataset files."""
