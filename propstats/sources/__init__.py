"""Readers and writers. Only these and the plans touch storage."""
