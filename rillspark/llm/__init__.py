"""Training-data operators: ten jobs over text tables, each a Spark plan of its own.

Nothing outside this folder imports it.
"""
