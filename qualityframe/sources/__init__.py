"""qualityframe.sources."""
