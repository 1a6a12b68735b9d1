"""Readers and writers of files and run partitions."""
