"""Weftline plans."""
