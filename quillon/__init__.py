"""Bibliographic integrity over corpora, as Spark jobs: audit, discovery, reconciliation and placement of citations."""
