"""Byte-level BPE encoding and decoding over overlapping chunks.

A text of more than `chunk` characters is cut into chunks that overlap. Chunks are
pre-tokenised in parallel. Pre-tokens never look back, so once a chunk and the next
one both start a pre-token at the same place, they agree from there on: that place
becomes the cut. The pieces between cuts are encoded in parallel and their ids put
together in order. If two chunks of a text share no place (a pre-token longer than
the overlap), that text is encoded in one piece. Shorter texts are one chunk.

Ids travel as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import plain, structs, unused

CHUNK, OVERLAP = 1 << 15, 1 << 10
# A pre-token that starts this many characters before the end of a chunk is not
# changed by what follows; contractions look three characters ahead.
AHEAD = 8


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Pieces(dict):
    """Ids of pre-tokens as bytes, remembered up to a bound per worker."""

    bound = 100_000

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})._encode_single_piece

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode(token))
        if len(token) < 64:
            self[token] = ids
        return ids


@lru_cache(maxsize=2)
def _pieces(path: str, pattern: str) -> _Pieces:
    return _Pieces(path, pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(maxsize=2)
def _matcher(pattern: str):
    return regex.compile(pattern)


def _coded(text: Column, path: str, pattern: str) -> Column:
    """Struct of the ids and the bytes they decode to, both made by the same worker."""

    @F.arrow_udf("struct<ids:binary,raw:binary>")
    def run(texts: pa.Array) -> pa.Array:
        split, ids, token = _matcher(pattern).findall, _pieces(path, pattern).__getitem__, _tokens(path).__getitem__
        coded = [b"".join(map(ids, split(t))) for t in plain(texts)]
        return structs(ids=(coded, pa.binary()), raw=([_decoded(c, token) for c in coded], pa.binary()))

    return run(text)


def _decoded(ids: bytes, token: Callable[[int], bytes]) -> bytes:
    import numpy as np

    return b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def _edges(text: Column, last: Column, pattern: str, chunk: int, overlap: int) -> Column:
    """Places in the overlaps at which a pre-token starts: head, from the chunk's start; tail, from the next one's."""

    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def run(texts: pa.Array, lasts: pa.Array) -> pa.Array:
        heads, tails = [], []
        for t, is_last in zip(plain(texts), lasts.to_pylist(), strict=True):
            sure = len(t) if is_last else len(t) - AHEAD
            starts = [m.start() for m in _matcher(pattern).finditer(t)]
            heads.append([p for p in starts if p < overlap and p <= sure])
            tails.append([p - chunk for p in starts if chunk <= p <= sure])
        return structs(head=(heads, pa.list_(pa.int32())), tail=(tails, pa.list_(pa.int32())))

    return run(text, last)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", raw: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The kept columns of every row, the ids of its text and, if raw is named, the bytes they decode to.

    A null text counts as empty and has no ids. Repeated rows give repeated
    results; keys may be null. Other columns of docs play no part.
    """
    long_text = F.coalesce(F.length(text), F.lit(0)) > chunk
    (coded,) = unused(docs, "coded")
    short = docs.filter(~long_text).select(*keep, _coded(F.col(text), path, pattern).alias(coded))
    both = short.unionByName(_long(docs.filter(long_text), path, pattern, text, keep, coded, chunk, overlap))
    return both.select(*keep, F.col(f"{coded}.ids").alias(ids), *([F.col(f"{coded}.raw").alias(raw)] if raw else []))


def _long(docs: DataFrame, path: str, pattern: str, text: str, keep: tuple[str, ...], coded: str, chunk: int, overlap: int) -> DataFrame:
    kept = F.struct(*(F.col(c) for c in keep)).alias("kept")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept, F.col(text).alias("body"))
    last = ((F.length("body") - 1) / chunk).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.substring(F.col("body"), i * chunk + 1, F.lit(chunk + overlap)).alias("part"), (i == last).alias("last")))
    # Written once: the row numbers must not change if a task is run again.
    chunks = settle(rows.select("row", "kept", F.inline(cut)), "bpe-chunks").repartition(F.col("row"), F.col("i"))
    seen = chunks.select("row", "i", _edges(F.col("part"), F.col("last"), pattern, chunk, overlap).alias("e")).select("row", "i", "e.head", "e.tail")
    order = Window.partitionBy("row").orderBy("i")
    meets = seen.select("row", "i", F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("next"), F.lead("i").over(order).isNotNull().alias("more"))
    cuts = settle(
        meets.select("row", "i", "next", F.lag("next").over(order).alias("start"), F.min(F.when(F.col("more"), F.col("next").isNotNull().cast("int")).otherwise(1)).over(Window.partitionBy("row")).alias("whole")),
        "bpe-cuts",
    )
    placed = chunks.join(cuts, ["row", "i"])
    begin = F.coalesce(F.col("start"), F.lit(0))
    end = F.when(F.col("last"), F.length("part")).otherwise(chunk + F.col("next"))
    stitched = placed.filter("whole = 1").select("row", "kept", "i", F.substring(F.col("part"), begin + 1, end - begin).alias("piece"))
    # Texts that never resynchronise: put together again and encoded in one piece.
    loose = placed.filter("whole = 0").select("row", "kept", "i", F.substring(F.col("part"), F.lit(1), F.lit(chunk)).alias("part"))
    one = loose.groupBy("row").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts"))
    one = one.select("row", "kept", F.lit(0).alias("i"), F.array_join(F.col("parts.part"), "").alias("piece"))
    done = stitched.unionByName(one).select("row", "kept", "i", _coded(F.col("piece"), path, pattern).alias("coded"))
    per_row = done.groupBy("row").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("i", "coded"))).alias("parts"))

    def joined(name: str) -> Column:
        return F.aggregate(F.col(f"parts.coded.{name}"), F.lit(b""), lambda a, b: F.concat(a, b)).alias(name)

    return per_row.select(*(F.col("kept").getField(c).alias(c) for c in keep), F.struct(joined("ids"), joined("raw")).alias(coded))


def decode(ids: Column, path: str) -> Column:
    """The raw bytes of the ids, put together in order; null stays null."""

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        token = _tokens(path).__getitem__
        return pa.array([None if b is None else _decoded(b, token) for b in batch.to_pylist()], pa.binary())

    return run(ids)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **sizes: int) -> DataFrame:
    """Per row: the kept columns, n_tokens, ids_sha256, and decoded_sha256 after the round trip."""
    ids, raw = unused(docs, "ids", "raw")
    coded = encode(docs, path, pattern, text, keep, ids, raw, **sizes)
    return coded.select(*keep, n_ids(F.col(ids)).alias("n_tokens"), F.sha2(F.col(ids), 256).alias("ids_sha256"), F.sha2(F.col(raw), 256).alias("decoded_sha256"))
