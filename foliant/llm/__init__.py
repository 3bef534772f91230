"""Operators that prepare text for training: one module each, on top of runtime.py and arrays.py."""
