"""File-inventory analytics on Spark DataFrames.

The package is organised by what a DataFrame goes through: ``sources`` make inventories, ``functions`` are column
expressions, ``operators`` map relations to relations, ``plans`` derive action lists and ``streaming`` runs profiles
over arriving files.  The optional subpackage ``llm`` is used by nothing here.
"""
