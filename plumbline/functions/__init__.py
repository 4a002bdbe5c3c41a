"""plumbline functions."""
