"""Subpackage of voltrace."""
