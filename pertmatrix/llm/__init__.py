"""Operators for training-data pipelines. Nothing outside this folder imports them, apart from the guarded line of the driver's entry."""
