"""Readers, header mapping and sinks."""
