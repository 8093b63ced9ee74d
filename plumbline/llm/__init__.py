"""Operators for preparing training corpora; nothing else in plumbline imports this subpackage."""
