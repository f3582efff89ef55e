"""Operators over DataFrames of papers, pages, sections, chunks, vectors and turns."""
