"""Operators for preparing training data. Nothing else in weft imports this subpackage."""
