"""Readers, panels and sinks."""
