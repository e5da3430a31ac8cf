"""Operators for building language-model training corpora; nothing outside this package imports it."""
