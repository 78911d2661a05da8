"""Readers.  Each has a ``read_…`` for files and a ``parse_…`` for documents already in a table.

Documents are rows (project, path, text).  Readers return good rows and diagnostics: a bad
document is set aside with its finding and the others are read.
"""
