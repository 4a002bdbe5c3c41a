"""plumbline plans."""
