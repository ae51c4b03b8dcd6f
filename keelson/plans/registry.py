"""All queries of the engine and the SQL that checks them."""

from __future__ import annotations

from keelson.plans import agreement_queries, cell_queries, experiment_queries, model_queries, record_queries, search_queries, segment_queries, text_queries  # noqa: F401
from keelson.plans.bindings import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "c14_id_vlm_f50"
