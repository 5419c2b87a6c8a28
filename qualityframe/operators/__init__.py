"""qualityframe.operators."""
