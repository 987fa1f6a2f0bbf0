"""Scalar helpers and session plumbing."""
