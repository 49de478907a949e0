"""Readers, inference, extraction and sinks."""
