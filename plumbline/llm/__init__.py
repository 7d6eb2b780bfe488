"""Operators for preparing training corpora. Nothing else in plumbline imports this subpackage."""
