"""All registered queries of the library's own operators."""

from . import queries_induce, queries_sets, queries_text, queries_xml  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "upstream"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
