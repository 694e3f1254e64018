"""hostshelf.operators."""
