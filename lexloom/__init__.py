"""lexloom: a PySpark-native engine for structured legal documents.

Acts, structural units, text chunks, citations and thesaurus topics live in flat
tables; every operator is a function from DataFrames to DataFrames.
"""

__version__ = "0.1.0"
