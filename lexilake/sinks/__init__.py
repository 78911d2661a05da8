"""Writers.

Documents are tables of ordered fragments, one row per line or entry.  A catalog of any size is
then written by as many tasks as it needs: its fragments, concatenated in part-file order, are
the document.  Nothing gathers a catalog into one row.
"""
