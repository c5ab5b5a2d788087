"""quern: a Spark-native archive and query engine for agent session logs.

The package holds the data-processing operators (``operators``), readers and
writers (``sources``), column functions (``functions``), registered queries with
their SQL counterparts (``plans``) and the streaming front end (``streaming``).
``quern.llm`` is optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
