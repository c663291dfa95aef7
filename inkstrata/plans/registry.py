"""All registered queries of the document engine and their SQL."""

from . import catalogue, edit_queries, format_queries, overlay_queries, reader_queries  # noqa: F401  (importing the others registers their queries)

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL
