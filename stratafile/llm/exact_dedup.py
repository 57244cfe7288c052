"""Exact dedup: a minimal perfect hash over the historical distinct digests.

Historical rows are reduced to distinct digests with their winner. Digests fall into buckets of about KEYS_PER_BUCKET, historical or fresh, whichever are more; each bucket gets
its own minimal perfect hash, so that no build holds more than a bucket. A level is a bit array of twice the keys left; keys alone on
their bit settle there, the others go on to the next level; a key's slot is the rank of its bit. Slots hold the full
digest and the locator of the winner. Fresh digests, already distinct, meet the bucket's hash in one task; a hit counts
only if all bytes in the slot are equal. Nonmembers are grouped among themselves.

Defined cases: a null text is the empty text; rows that repeat a doc_id are one document and share its verdict, each counted in
group_size; a null doc_id never wins against a number; of a group without any doc_id one row is kept, with a null keep_id; a history of any size, or none, does; texts of any length are hashed whole; an empty
table gives an empty result; columns beside the id, the text and the history flag are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import normal_spaces, written

KEYS_PER_BUCKET = 8192
#: Bits of a level for each key that is left.
GAMMA = 2
DIGEST = 32
INDEX_SCHEMA = "bucket long, n long, levels array<long>, bits binary, slots binary, winners binary, counts binary"
FOUND_SCHEMA = "digest binary, keep_id long, n long"


def _places(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    """A place below m for each key (rows of four unsigned 64-bit words), another one at each level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD6E8FEB86659FD93 + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27)) ^ keys[:, 2]) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31)) ^ keys[:, 3]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(m)).astype(np.int64)


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, DIGEST // 8)


def build(digests: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Level sizes and all levels' bits, end to end, of a minimal perfect hash over distinct digests."""
    left, sizes, parts = _words(digests), [], []
    while len(left):
        m = max(8, GAMMA * len(left))
        at = _places(left, len(sizes), m)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        parts.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def slots_of(digests: list[bytes], sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has its bit. A digest that was not built in may get any slot."""
    keys = _words(digests)
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, left, start = np.full(len(keys), -1), np.arange(len(keys)), 0
    for level, m in enumerate(sizes):
        at = start + _places(keys[left], level, m)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + m
    return out


def _build_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests = [bytes(x) for x in rows["digest"]]
    sizes, bits = build(digests)
    at = slots_of(digests, sizes, bits)
    order = np.argsort(at)
    winners, none = rows["winner"].to_numpy(dtype=object)[order], np.iinfo(np.int64).min
    return pd.DataFrame([{
        "bucket": int(key[0]), "n": len(digests), "levels": sizes, "bits": np.packbits(bits).tobytes(), "slots": b"".join(digests[i] for i in order),
        "winners": np.array([none if pd.isna(x) else int(x) for x in winners], "<i8").tobytes(), "counts": rows["n"].to_numpy("<i8")[order].tobytes(),
    }])


def _look_up(key: tuple, index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    """The bucket's historical slots with the repeats that hit them, and its nonmembers."""
    digests = [bytes(x) for x in fresh["digest"]]
    ids, n = fresh["winner"].to_numpy(dtype=object), fresh["n"].to_numpy("int64")
    if not len(index):
        return pd.DataFrame({"digest": digests, "keep_id": pd.array(ids, "Int64"), "n": n})
    row = index.iloc[0]
    sizes = [int(x) for x in row["levels"]]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
    slots = [bytes(row["slots"][i : i + DIGEST]) for i in range(0, DIGEST * int(row["n"]), DIGEST)]
    winners, total = np.frombuffer(row["winners"], "<i8"), np.frombuffer(row["counts"], "<i8").copy()
    at = slots_of(digests, sizes, bits) if digests else np.zeros(0, int)
    member = np.array([i >= 0 and slots[i] == d for i, d in zip(at, digests)], bool)
    if member.any():
        np.add.at(total, at[member], n[member])
    none = np.iinfo(np.int64).min
    keep = [None if x == none else int(x) for x in winners]
    for i, x in zip(at[member], ids[member]):  # a winner without an id gives way to one with an id
        keep[i] = x if keep[i] is None and not pd.isna(x) else keep[i]
    return pd.DataFrame({"digest": slots + [d for d, m in zip(digests, member) if not m], "keep_id": pd.array([*keep, *ids[~member]], "Int64"), "n": np.concatenate([total, n[~member]])})


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """history (digest, winner, n), distinct by digest -> one row per bucket with its hash, slots and locators. Write it to keep it."""
    return history.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_build_bucket, INDEX_SCHEMA)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long")


def exact_dedup(docs: DataFrame, history: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    history says which rows are the historical batch, whose winners stay (of equal ones the smallest doc_id); by default the rows up to the
    middle of the range of doc_id. Fresh rows stay only if no historical row has their text."""
    id_, flag = F.col(doc_id).cast("long"), history
    rows = docs.select(id_.alias("doc_id"), F.unhex(F.sha2(normal_spaces(F.col(text)), 256)).alias("digest"), *([F.coalesce(flag, F.lit(False)).alias("old")] if flag is not None else []))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "op6-digests")
    if flag is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        middle = None if low is None else low + (high - low) // 2
        rows = rows.withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False)))
    distinct = rows.groupBy("digest", "old").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n"))
    # no more digests than rows, so buckets hold KEYS_PER_BUCKET of either kind at most on average
    n_old, n_fresh, n_null = rows.agg(F.count_if("old"), F.count_if(~F.col("old")), F.count_if(F.col("doc_id").isNull())).first()
    buckets = max(1, -(-max(n_old, n_fresh) // KEYS_PER_BUCKET))
    index = build_index(distinct.where("old").drop("old"), buckets)
    fresh = distinct.where("not old").drop("old").withColumn("bucket", _bucket(buckets))
    verdicts = index.groupBy("bucket").cogroup(fresh.groupBy("bucket")).applyInPandas(_look_up, FOUND_SCHEMA)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    if n_null:
        nameless = rows.where("doc_id is null").groupBy("digest").agg(F.min("row").alias("stays"))
        rows, kept = rows.join(nameless, "digest", "left"), kept | F.coalesce(F.col("keep_id").isNull() & (F.col("row") == F.col("stays")), F.lit(False))
    return rows.join(verdicts, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
