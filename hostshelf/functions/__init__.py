"""hostshelf.functions."""
