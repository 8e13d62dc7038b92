"""Tensors that a stream of increments maintains."""
