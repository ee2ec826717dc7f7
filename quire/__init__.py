"""Analytics over corpora of word-processing documents, on Spark."""

from __future__ import annotations


def read(spark, path: str):
    """The packages under path as a Corpus of lazy node tables."""
    from .operators.extract import Corpus
    from .sources.package import read_packages

    return Corpus(read_packages(spark, path).select("doc_id", "content"))
