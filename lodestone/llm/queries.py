"""The queries of the ten operators, and their SQL where there is any."""

from __future__ import annotations

from . import bpe, embdedup, langid, linededup, media, mixing, pii, sharding, simhash, toxicity

QUERIES = {
    "op1_embedding_neardup": embdedup.embedding_neardup,
    "op2_line_dedup": linededup.line_dedup,
    "op3_toxicity": toxicity.toxicity,
    "op4_simhash_neardup": simhash.simhash_neardup,
    "op5_media_chunks": media.media,
    "op6_bpe": bpe.bpe,
    "op7_language_id": langid.langid,
    "op8_sharding": sharding.sharding,
    "op9_mixing": mixing.mixing,
    "op10_pii": pii.pii,
}
ORACLES = {"op1_embedding_neardup": embdedup.EMBEDDING_SQL, "op9_mixing": mixing.MIXING_SQL}
