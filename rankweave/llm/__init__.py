"""Operators of a large training-data pipeline. Nothing else in rankweave imports this subpackage."""
