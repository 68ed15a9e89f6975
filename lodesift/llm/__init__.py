"""Operators that prepare training corpora; nothing outside this package imports it."""
