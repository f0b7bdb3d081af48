"""aula: lecture analytics on Spark.

Core packages: ``sources`` (tables, files, vector store), ``functions`` (column helpers),
``operators`` (dataflow operators), ``plans`` (registered queries with their SQL), ``streaming``.
The subpackage ``llm`` holds the training-data operators; nothing in the core imports it.
"""
