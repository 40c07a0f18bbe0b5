"""Readers and writers: files, code, tables, caches, reports."""
