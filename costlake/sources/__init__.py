"""Readers, billing normalizers and table writers."""
