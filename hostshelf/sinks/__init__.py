"""hostshelf.sinks: versioned snapshot tables."""
