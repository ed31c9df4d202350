"""Imports every plan module, which fills the catalog."""

from . import evaluation_queries, model_queries, output_queries, packet_queries, table_queries  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
