"""Tensors and networks on storage."""
