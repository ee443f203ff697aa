"""Table readers, sinks and run catalogs."""
