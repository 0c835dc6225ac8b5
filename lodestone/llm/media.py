"""Operator 5: content-defined chunking of media columns, chunk deduplication and verified reconstruction.

A payload is cut where a rolling gear hash of its last 32 bytes has MASK_BITS zero bits. Chunks are known
by their SHA-256; the first medium (by id, then place) that holds a chunk owns it, and a recipe lists, in
order, every chunk of a medium with the place of its owner's copy. Payloads stay where they are: digests
and places move through the joins, and bytes only for chunks that another medium owns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import maybe_broadcast, read, written
from .textvec import mix64

WINDOW = 32
MIN_BYTES, MASK_BITS, MAX_BYTES = 256, 10, 4096
#: zstd's, for payloads that travel.
PACK_LEVEL = 3
#: Recipes of at most so many media are broadcast.
BROADCAST_MEDIA = 50_000
GEAR = (mix64(np.arange(256, dtype=np.uint64), 99) >> np.uint64(32)).astype(np.uint32)
CHUNK = "array<struct<digest:binary,start:int,size:int>>"


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash (h << 1) + GEAR[byte], modulo 2**32, so of the last 32 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: np.ndarray, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS, max_bytes: int = MAX_BYTES) -> list[int]:
    """The end of each chunk. Chunks have min_bytes (at least WINDOW) to max_bytes, but for the last, which may be shorter."""
    n, low = len(data), max(min_bytes, WINDOW)
    if not n:
        return []
    ends = np.flatnonzero((gear(data) >> np.uint32(32 - mask_bits)) == 0) + 1
    out, start = [], 0
    while n - start > low:
        k = np.searchsorted(ends, start + low)
        end = min(int(ends[k]) if k < len(ends) else n, start + max_bytes, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_BYTES, mask_bits: int = MASK_BITS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, n_bytes, digest, chunks) of each row of df, with no shuffle. Null payloads have nulls, empty ones no chunks."""
    df = df.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"))

    def run(batches):
        for batch in batches:
            sizes, digests, chunks = [], [], []
            for x in batch.column(1):
                data = None if not x.is_valid else memoryview(x.as_buffer())
                if data is None:
                    sizes.append(None), digests.append(None), chunks.append(None)
                    continue
                ends = cuts(np.frombuffer(data, np.uint8), min_bytes, mask_bits, max_bytes)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).digest())
                chunks.append([{"digest": hashlib.sha256(data[s:e]).digest(), "start": s, "size": e - s} for s, e in zip([0, *ends], ends)])
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("size", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(chunks, kind)], ["id", "n_bytes", "digest", "chunks"])

    id_type = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {id_type}, n_bytes long, digest binary, chunks {CHUNK}")


def places(chunked: DataFrame) -> DataFrame:
    """(id, places) with places = [(pos, digest, size, owner, owner_start)] of the chunks whose first copy is elsewhere; media without any have no row."""
    entry = chunked.filter("id is not null").select("id", F.posexplode("chunks").alias("pos", "c")).select("id", "pos", "c.digest", "c.start", "c.size")
    owners = entry.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("own")).select("digest", F.col("own.id").alias("owner"), F.col("own.start").alias("owner_start"))
    moved = entry.join(owners, "digest").filter("owner <> id or owner_start <> start")
    return moved.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size", "owner", "owner_start"))).alias("places"))


def rebuild(df: DataFrame, chunked: DataFrame, moved: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, n_bytes, digest, chunks, rebuilt binary, owned_bytes, verified) from the ordered chunk lists, their places and the owners' payloads.

    Ids are unique and not null here. A chunk that `moved` (places' rows) has an owner for comes from that
    owner's payload, any other from the medium's own; each is checked against its digest, and the whole
    against the medium's. The payload meets list, places and pieces in one shuffle by id.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    owned = df.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=PACK_LEVEL)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(p) if p is not None else None for p in batch.column(1).to_pylist()], pa.binary())], ["id", "packed"])

    def export(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, pieces = [], []
            for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = open_.decompress(packed)
                for w in wanted:
                    digests.append(w["digest"])
                    pieces.append(payload[w["owner_start"] : w["owner_start"] + w["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(pieces, pa.binary())], ["digest", "piece"])

    def join(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "digest", "packed", "chunks", "places", "foreign")]
            built, own, good = [], [], []
            for me, digest, packed, chunks, elsewhere, foreign in zip(*rows):
                if digest is None:
                    built.append(None), own.append(None), good.append(None)
                    continue
                payload = open_.decompress(packed)
                other = {f["digest"]: f["piece"] for f in foreign or []}
                place = {c["pos"]: c for c in elsewhere or []}
                parts, size = [], 0
                for k, c in enumerate(chunks):
                    at = place.get(k)
                    if at is None:
                        parts.append(payload[c["start"] : c["start"] + c["size"]])
                        size += c["size"]
                    elif at["owner"] == me:
                        parts.append(payload[at["owner_start"] : at["owner_start"] + at["size"]])
                    else:
                        parts.append(other.get(at["digest"], b""))
                out = b"".join(parts)
                built.append(out), own.append(size)
                good.append(hashlib.sha256(out).digest() == digest and all(hashlib.sha256(p).digest() == c["digest"] for p, c in zip(parts, chunks)))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "n_bytes", "digest", "chunks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(built, pa.binary()), pa.array(own, pa.int64()), pa.array(good, pa.bool_())], ["id", "n_bytes", "digest", "chunks", "rebuilt", "owned_bytes", "verified"])

    packed = owned.mapInArrow(pack, f"id {id_type}, packed binary")
    borrowed = moved.select("id", F.explode("places").alias("c")).filter("c.owner <> id")
    wanted = borrowed.groupBy(F.col("c.owner").alias("id")).agg(F.collect_set(F.struct("c.digest", "c.owner_start", "c.size")).alias("wanted"))
    pieces = packed.join(maybe_broadcast(wanted, BROADCAST_MEDIA), "id").select("packed", "wanted").mapInArrow(export, "digest binary, piece binary")
    foreign = borrowed.select("id", "c.digest").distinct().join(pieces, "digest").groupBy("id").agg(F.collect_list(F.struct("digest", "piece")).alias("foreign"))
    full = packed.join(chunked, "id").join(moved, "id", "left").join(foreign, "id", "left")
    return full.mapInArrow(join, f"id {id_type}, n_bytes long, digest binary, chunks {CHUNK}, rebuilt binary, owned_bytes long, verified boolean")


def media_chunks(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """One row a medium: its size, SHA-256, ordered chunk digests, how many of its bytes it owns, and
    whether its reconstruction from the chunk owners' copies is byte for byte the same.

    Null payloads have nulls throughout; empty payloads have no chunks and are verified. A null id is an id
    like any other, and rows with one id but different payloads are different media, each with its row; rows
    alike in both are one medium. Extra columns aren't looked at.
    """
    payload = F.col(payload_col).cast("binary")
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(payload).alias("hash")).alias("id"), payload.alias("payload"))
    chunked = written(chunk(rows, "id", "payload"), "chunks")
    twice = chunked.groupBy("id").count().filter("count > 1")
    if not twice.isEmpty():
        extra = rows.join(twice.select("id"), "id", "left_semi")
        first = extra.groupBy("id").agg(F.min_by("payload", F.sha2("payload", 256)).alias("payload"))
        rows = rows.join(twice.select("id"), "id", "left_anti").unionByName(first)
        chunked = written(chunk(rows, "id", "payload"), "chunks")
    out = rebuild(rows, chunked, written(places(chunked), "places"), "id", "payload")
    names = F.expr("transform(chunks, c -> lower(hex(c.digest)))")
    return out.select(F.col("id.id").alias(id_col), "n_bytes", F.lower(F.hex("digest")).alias("digest"), F.when(F.col("digest").isNotNull(), F.size("chunks")).alias("n_chunks"), names.alias("chunks"), "owned_bytes", "verified")


def media(spark, sf_dir: str) -> DataFrame:
    """Every page's html, chunked, deduplicated and rebuilt."""
    return media_chunks(read(spark, sf_dir, "pages"))
