"""Operators for building training corpora out of raw documents; nothing outside this folder imports them."""
