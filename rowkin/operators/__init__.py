"""DataFrame-to-DataFrame steps of a linkage run."""
