"""quern: curation, feature and evaluation operators for short-text corpora on Spark DataFrames."""

__version__ = "0.1.0"
