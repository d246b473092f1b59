"""Operators of a training-data pipeline, as Spark jobs.

Nothing else in the library imports this subpackage.  ``clickpath.llm.queries``
holds the registered queries and their DuckDB SQL.
"""
