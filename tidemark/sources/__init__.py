"""Readers, validation on read, and sinks."""
