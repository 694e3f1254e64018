"""Training-data operators: dedup, tokenising, language id, licences, packing, quality.

Nothing outside this subpackage imports it; `hostshelf.llm.catalog` holds the
registered queries and their SQL.
"""
