"""Operators of quillspark."""
