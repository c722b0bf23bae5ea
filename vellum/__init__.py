"""vellum: knowledge-base and text-corpus analytics on Spark DataFrames.

Documents, entities and topics are tables; the inverted index is a table;
search, tree counts, change application and audits are DataFrame jobs.
"""

__version__ = "0.1.0"
