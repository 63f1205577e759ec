"""Factor analytics on bar panels, and operators for training data, on Spark."""
