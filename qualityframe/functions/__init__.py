"""qualityframe.functions."""
