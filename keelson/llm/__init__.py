"""Training-data operators: deduplication, filters, tokenisation and token files.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; ``queries`` derives the registered digests from them.
"""
