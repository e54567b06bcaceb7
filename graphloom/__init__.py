"""graphloom: evidence-grounded question answering over a knowledge graph and a text corpus, on Spark DataFrames."""

__version__ = "0.1.0"
