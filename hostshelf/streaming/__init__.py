"""hostshelf.streaming."""
