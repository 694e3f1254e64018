"""hostshelf.plans."""
