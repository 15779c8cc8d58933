"""All queries of the subpackage, and the corpus pipeline at the top of the repository."""

from __future__ import annotations

import corpus_pipeline

from . import (  # noqa: F401
    byte_bpe,
    centroids,
    exact_dedup,
    html_extraction,
    language,
    language_model,
    lexical,
    minhash,
    neighbours,
    packing,
    quality,
    suffix_dedup,
    toxicity,
)
from .catalog import QUERIES, SQL  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
