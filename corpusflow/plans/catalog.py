"""Loads every catalog module, which registers its queries."""

from corpusflow.plans import (  # noqa: F401
    catalog_context,
    catalog_dialog,
    catalog_eval,
    catalog_graph,
    catalog_ingest,
    catalog_papers,
    catalog_retrieval,
    catalog_sources,
    catalog_tabular,
)

FLAGSHIP = "t07_hybrid_retrieve"
