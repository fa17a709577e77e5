"""Operators that prepare large text and sequence collections; nothing outside this subpackage imports it."""
