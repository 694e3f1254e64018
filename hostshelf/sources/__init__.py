"""hostshelf.sources."""
