"""Composed plans (adaptive retrieval, evaluation, serving) and the named query catalog."""
