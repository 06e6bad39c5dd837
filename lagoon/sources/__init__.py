"""Readers and shape-changing scans."""
