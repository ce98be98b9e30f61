"""Streaming of quillspark."""
