"""Training-data operators: packing, mixing, search, scanning, scoring and de-duplication.

Nothing outside this subpackage imports it; `queries.py` lists the registered queries.
"""
