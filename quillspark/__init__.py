"""quillspark: a Spark-native engine for document corpora.

Ingest, split and clean raw texts, keep them in partitioned lake layouts, build a
positional inverted index, and answer Boolean term and metadata queries. Everything is a
DataFrame plan; see README.md for the map of modules.
"""

__version__ = "1.1.9"
