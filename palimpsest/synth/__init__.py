"""Synthetic annotated documents from templates."""
