"""Training-data operators: text scans, classifiers, near-duplicates, tokens, packing.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` of
:mod:`memlake.llm.queries` are added to the entry point when the subpackage is there.
"""
