"""Operators for training-data pipelines: each module holds one operator, its query and,
where SQL can express it, its oracle statement. Nothing else in the package imports this."""
