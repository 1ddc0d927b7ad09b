"""Operators of the command language: each takes a frame and gives a frame."""
