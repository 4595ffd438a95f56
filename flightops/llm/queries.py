"""All queries of the subpackage and their oracle statements."""

from __future__ import annotations

from . import (chat_prefixes, collocations, decision_lists, embedding_dedup, html_extraction,
               interpolated_lm, merkle_manifest, neighbour_quality, nnls_packing, sharding,
               simhash_dedup, source_mixing, token_counts)

_MODULES = (sharding, simhash_dedup, source_mixing, neighbour_quality, chat_prefixes,
            interpolated_lm, nnls_packing, embedding_dedup, decision_lists, token_counts,
            collocations, html_extraction, merkle_manifest)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
