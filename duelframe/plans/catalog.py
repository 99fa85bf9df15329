"""All registered queries (importing a module registers its queries)."""

from . import q_history, q_ingest, q_models, q_names, q_parse, q_review, q_slate, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
