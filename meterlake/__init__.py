"""meterlake: what coding agents cost and how they perform, and operators for training data, on Spark."""
