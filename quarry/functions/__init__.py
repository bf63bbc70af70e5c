"""Column-level expressions (no joins): text, vectors, typos."""
