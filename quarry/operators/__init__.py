"""Relational operators over chunks, manifests and rankings."""
