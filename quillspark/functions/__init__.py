"""Functions of quillspark."""
