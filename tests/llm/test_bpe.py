from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken

from codelabels.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REAL = tiktoken.Encoding("real", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(7)
    parts = ["word", " ", "  ", "\n", "\n\n  ", "it's", "we'll", "don't", "Ünï", "日本語", "12345", "!?", "x" * 40, " ", "\t", "'", "🙂", "a"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(120)]
    return made + ["", None, "x" * 3000, " " * 2500, "word " * 400, "<|endoftext|>" * 50, "a'" * 300, "word " * 400]


def test_same_ids_as_the_library(spark):
    rows = [(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")
    for chunk, overlap in ((64, 24), (200, 60), (1 << 15, 1 << 10)):
        found = sorted(map(tuple, bpe.digests(docs, PATH, PATTERN, chunk=chunk, overlap=overlap).collect()), key=str)
        wanted = []
        for i, t, *_ in rows:
            ids = REAL.encode_ordinary(t or "")
            raw = REAL.decode_bytes(ids)
            assert raw == (t or "").encode()
            wanted.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(raw).hexdigest()))
        assert found == sorted(wanted, key=str)
    ids = bpe.encode(docs, PATH, PATTERN)
    assert ids.columns == ["doc_id", "ids"]
    raw = ids.select(bpe.decode(ids["ids"], PATH).alias("raw"))
    assert sorted(bytes(r["raw"]) for r in raw.collect()) == sorted((t or "").encode() for _, t, *_ in rows)


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_letters_and_blanks_as_in_the_library():
    """Classes of characters agree with the library over the whole range."""
    split = bpe._matcher(PATTERN).findall
    odd = []
    for low in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1 " for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        if [i for t in split(text) for i in REAL._encode_single_piece(t)] != REAL.encode_ordinary(text):
            odd.append(low)
    assert odd == []
