"""qualityframe.plans."""
