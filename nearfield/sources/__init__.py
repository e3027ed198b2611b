"""Readers and writers of vector, truth and metrics files."""
