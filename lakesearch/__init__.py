"""Semantic code and text retrieval as Spark table jobs.

Files become definition-level chunks, chunks become normalised vectors, and a
table of queries is answered with exact inner-product top-k, a metadata join and
a second scoring pass over the shortlist.
"""
