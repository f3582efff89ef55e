"""Operators for large text corpora: fingerprints, dedup, filters, tokens, archives, mixing.

Nothing outside this package imports it.  Every operator selects the columns it
needs by name and works on private ``_cl_*`` names, so further input columns,
whatever they are called, pass through or are ignored.
"""
