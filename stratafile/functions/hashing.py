"""Hashes of files: MD5 and BLAKE3, read in pieces where the files are reached."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

PIECE = 1 << 20
#: The first and last bytes of a file that tell most files of a size apart.
ENDS = 1 << 16
#: Files of this size and more are hashed by BLAKE3 in parts of PART_CHUNKS chunks (64 MB), a task each.
LARGE, PART_CHUNKS = 1 << 28, 1 << 16
#: Parts whose chaining values are folded at once.
FAN = 1024

# Fixed values of BLAKE3, from its published specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024
#: Chunks that are compressed side by side.
LANES = 1024


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values of many blocks at once. cv: (n, 8), block: (n, 16), the rest (n,); all unsigned 32-bit but for counter."""
    n = len(cv)
    v = np.empty((16, n), np.uint32)
    v[:8] = cv.T
    v[8:12] = np.array(IV[:4], np.uint32)[:, None]
    v[12], v[13] = (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v[14], v[15] = length, flags
    m = block.T.copy()

    def turn(x, r):
        return (x >> np.uint32(r)) | (x << np.uint32(32 - r))

    def mix(a, b, c, d, x, y):
        v[a] += v[b] + x
        v[d] = turn(v[d] ^ v[a], 16)
        v[c] += v[d]
        v[b] = turn(v[b] ^ v[c], 12)
        v[a] += v[b] + y
        v[d] = turn(v[d] ^ v[a], 8)
        v[c] += v[d]
        v[b] = turn(v[b] ^ v[c], 7)

    for r in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if r < 6:
            m = m[list(PERMUTATION)]
    return (v[:8] ^ v[8:]).T


def _chunk_values(words: np.ndarray, sizes: np.ndarray, counter: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Chaining values of n chunks. words: (n, 16, 16), sizes: their bytes, counter: their numbers, only: whether a chunk is a whole input."""
    n = len(words)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    cv = np.tile(np.array(IV, np.uint32), (n, 1))
    for b in range(CHUNK // BLOCK):
        go = np.flatnonzero(blocks > b)
        if not len(go):
            break
        last = blocks[go] == b + 1
        flags = np.where(b == 0, CHUNK_START, 0) | np.where(last, CHUNK_END | np.where(only[go], ROOT, 0), 0)
        length = np.where(last, sizes[go] - b * BLOCK, BLOCK)
        cv[go] = _compress(cv[go], words[go, b], counter[go], length.astype(np.uint32), flags.astype(np.uint32))
    return cv


def _chunks(data: bytes, first: int, only: bool) -> np.ndarray:
    """Chaining values of the chunks of data, the first being number `first`; only: the one chunk is the whole input."""
    n = max(1, -(-len(data) // CHUNK))
    words = np.frombuffer(data.ljust(n * CHUNK, b"\0"), "<u4").reshape(n, CHUNK // BLOCK, 16).astype(np.uint32)
    sizes = np.full(n, CHUNK)
    sizes[-1] = len(data) - (n - 1) * CHUNK
    return _chunk_values(words, sizes, np.arange(first, first + n, dtype=np.uint64), np.full(n, only))


def _parent(left: np.ndarray, right: np.ndarray, root: bool | np.ndarray) -> np.ndarray:
    n = len(left)
    flags = np.where(np.broadcast_to(root, n), PARENT | ROOT, PARENT).astype(np.uint32)
    return _compress(np.tile(np.array(IV, np.uint32), (n, 1)), np.concatenate([left, right], 1), np.zeros(n, np.uint64), np.full(n, BLOCK, np.uint32), flags)


class Blake3:
    """BLAKE3 of what update is given, 32 bytes."""

    def __init__(self):
        self.rest, self.done, self.stack = b"", 0, []  # stack: (height, chaining value), heights falling

    def update(self, data: bytes) -> None:
        self.rest += data
        # the last chunk stays, as it may be the root
        while len(self.rest) > LANES * CHUNK:
            self._take(LANES)
        n = (len(self.rest) - 1) // CHUNK if self.rest else 0
        if n >= 64:
            self._take(n)

    def _take(self, n: int) -> None:
        cvs = _chunks(self.rest[: n * CHUNK], self.done, False)
        self.rest = self.rest[n * CHUNK :]
        at = 0
        while at < n:
            # the largest whole subtree that starts here is folded level by level
            size = 1 << ((n - at).bit_length() - 1)
            while self.done % size:
                size //= 2
            nodes, height = cvs[at : at + size], size.bit_length() - 1
            while len(nodes) > 1:
                nodes = _parent(nodes[::2], nodes[1::2], False)
            at, self.done = at + size, self.done + size
            while self.stack and self.stack[-1][0] == height:
                nodes, height = _parent(self.stack.pop()[1], nodes, False), height + 1
            self.stack.append((height, nodes))

    def hexdigest(self) -> str:
        whole = max(0, (len(self.rest) - 1) // CHUNK)
        if whole:
            self._take(whole)
        node = _chunks(self.rest, self.done, not self.stack)
        stack = list(self.stack)
        while stack:
            _, left = stack.pop()
            node = _parent(left, node, not stack)
        return node.astype("<u4").tobytes().hex()


def digest(data: bytes, algorithm: str) -> str:
    h = hasher(algorithm)
    h.update(data)
    return h.hexdigest()


def hasher(algorithm: str):
    if algorithm == "md5":
        return hashlib.md5()
    if algorithm == "blake3":
        return Blake3()
    raise ValueError(f"unknown algorithm {algorithm!r}: md5 or blake3")


def hash_file(path: str, algorithm: str, progress: Callable[[int], None] | None = None) -> str:
    """The file's hash as lower-case hex; progress is told the bytes read so far."""
    h, read = hasher(algorithm), 0
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            h.update(piece)
            read += len(piece)
            if progress:
                progress(read)
    return h.hexdigest()


def algorithm_of(value: str) -> str:
    """By its length: 32 characters are MD5, 64 are BLAKE3."""
    try:
        return {32: "md5", 64: "blake3"}[len(value)]
    except KeyError:
        raise ValueError(f"no hash has {len(value)} characters") from None


def hash_files(files: DataFrame, algorithm: str = "blake3", path: str = "abs_path") -> DataFrame:
    """files with columns hash and error: the file at `path` is read by the executor that has the row, which must reach it; an unreadable
    file gives an error instead. Hand over only rows that need it, as every row is read."""
    hasher(algorithm)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, errors = [], []
            for p in batch[path]:
                try:
                    hashes.append(hash_file(p, algorithm))
                    errors.append(None)
                except (OSError, TypeError) as e:
                    hashes.append(None)
                    errors.append(str(e))
            yield batch.assign(hash=pd.Series(hashes, dtype=object, index=batch.index), error=pd.Series(errors, dtype=object, index=batch.index))

    rest = files.drop("hash", "error")
    return rest.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rest.dtypes) + ", hash string, error string")


def hash_ends(files: DataFrame, block: int = ENDS, path: str = "abs_path") -> DataFrame:
    """files with `ends`, MD5 of the first and last block of each (of all of a file of two blocks or fewer), null if it can't be read, and `read_bytes`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for p in batch[path]:
                try:
                    with open(p, "rb") as f:
                        size = f.seek(0, 2)
                        f.seek(0)
                        data = f.read(block if size > 2 * block else 2 * block)
                        if size > 2 * block:
                            f.seek(size - block)
                            data += f.read(block)
                    got.append((hashlib.md5(data).hexdigest(), len(data)))
                except (OSError, TypeError):
                    got.append((None, 0))
            yield batch.assign(ends=pd.Series([x[0] for x in got], dtype=object, index=batch.index), read_bytes=pd.Series([x[1] for x in got], dtype="int64", index=batch.index))

    return files.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", ends string, read_bytes long")


def same_as(pairs: DataFrame, path: str = "abs_path", other: str = "original_path") -> DataFrame:
    """pairs of paths with `same`: whether the two files agree byte by byte, null if one can't be read; reading stops at the first difference."""

    def equal(a: str, b: str) -> bool | None:
        try:
            with open(a, "rb") as x, open(b, "rb") as y:
                while True:
                    p, q = x.read(PIECE), y.read(PIECE)
                    if p != q:
                        return False
                    if not p:
                        return True
        except (OSError, TypeError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(same=pd.Series([equal(a, b) for a, b in zip(batch[path], batch[other])], dtype=object, index=batch.index))

    return pairs.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", same boolean")


def _folded(nodes: np.ndarray, count: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The one chaining value over each of several runs of nodes, count[i] in the i-th, level by level; an odd one goes up as it is. root: whether a run is that of a whole input."""
    while (count > 1).any():
        start = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(nodes)) - start[owner]
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < count[owner]))
        up = nodes[at % 2 == 0].copy()
        place = np.cumsum(at % 2 == 0) - 1
        up[place[left]] = _parent(nodes[left], nodes[left + 1], root[owner[left]] & (count[owner[left]] == 2))
        nodes, count = up, (count + 1) // 2
    return nodes


def _values(datas: list[bytes], first: list[int], whole: list[bool]) -> list[bytes]:
    """The chaining value of each of some stretches of chunks, side by side; first: the number of its first chunk, whole: whether it is an input as a whole."""
    out: list[bytes] = []
    i = 0
    while i < len(datas):
        if len(datas[i]) > LANES * CHUNK:
            d = datas[i]
            nodes = np.concatenate([_chunks(d[k : k + LANES * CHUNK], first[i] + k // CHUNK, False) for k in range(0, len(d), LANES * CHUNK)])
            out.append(_folded(nodes, np.array([len(nodes)]), np.array([whole[i]]))[0].astype("<u4").tobytes())
            i += 1
            continue
        j, held = i, 0
        while j < len(datas) and len(datas[j]) <= LANES * CHUNK and held <= LANES * CHUNK:
            held += len(datas[j]) + CHUNK
            j += 1
        some = datas[i:j]
        count = np.array([max(1, -(-len(d) // CHUNK)) for d in some])
        words = np.frombuffer(b"".join(d.ljust(n * CHUNK, b"\0") for d, n in zip(some, count.tolist())), "<u4").reshape(-1, CHUNK // BLOCK, 16).astype(np.uint32)
        owner, end = np.repeat(np.arange(len(some)), count), np.cumsum(count)
        at = np.arange(len(words)) - (end - count)[owner]
        sizes = np.full(len(words), CHUNK)
        sizes[end - 1] = np.array([len(d) for d in some]) - (count - 1) * CHUNK
        root = np.array(whole[i:j])
        nodes = _chunk_values(words, sizes, (np.array(first[i:j], np.uint64)[owner] + at.astype(np.uint64)), root[owner] & (count[owner] == 1))
        out += [x.tobytes() for x in _folded(nodes, count, root).astype("<u4")]
        i = j
    return out


def blake3_of(datas: list[bytes]) -> list[str]:
    """BLAKE3 of some inputs that are at hand, compressed side by side."""
    return [x.hex() for x in _values(datas, [0] * len(datas), [True] * len(datas))]


def blake3_in_parts(parts: DataFrame, read: Callable[[object, int, int], bytes | None], part_chunks: int) -> DataFrame:
    """(id, hash) of inputs that many tasks hash, a part each: BLAKE3 is a tree over chunks of 1024 bytes, and a part of a power of two of them is a subtree.

    parts: (id, source, size, part), a row for each part from 0, no id twice; read gives a part's bytes (source, first byte, how many). A task gives its part's chaining value, 32 bytes; then FAN parts in a row are
    folded in one group at a time, level by level, until each input has one value; so an input of any length is in no task as a whole. An input with a part that can't be read gets null."""
    size = part_chunks * CHUNK
    if part_chunks & (part_chunks - 1):
        raise ValueError("a part has a power of two of chunks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), step):
                own = batch.iloc[i : i + step]
                wants = [min(size, w - p * size) for w, p in zip(own["size"], own["part"])]
                datas = [read(x, p * size, n) for x, p, n in zip(own["source"], own["part"], wants)]
                good = [k for k, (d, n) in enumerate(zip(datas, wants)) if d is not None and len(d) == n]
                found = _values([datas[k] for k in good], [int(own["part"].iloc[k]) * part_chunks for k in good], [bool(own["size"].iloc[k] <= size) for k in good])
                out: list[bytes | None] = [None] * len(own)
                for k, v in zip(good, found):
                    out[k] = v
                yield pd.DataFrame({"id": own["id"], "part": own["part"], "top": own["top"], "cv": pd.Series(out, dtype=object, index=own.index)})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [[bytes(x["cv"]) if x["cv"] is not None else None for x in cvs] for cvs in batch["cvs"]]
            good = [k for k, r in enumerate(runs) if None not in r]
            out: list[bytes | None] = [None] * len(batch)
            if good:
                nodes = np.frombuffer(b"".join(x for k in good for x in runs[k]), "<u4").reshape(-1, 8).astype(np.uint32)
                found = _folded(nodes, np.array([len(runs[k]) for k in good]), batch["last"].to_numpy()[good].astype(bool))
                for k, v in zip(good, found.astype("<u4")):
                    out[k] = v.tobytes()
            yield pd.DataFrame({"id": batch["id"], "part": batch["part"], "top": batch["top"], "cv": pd.Series(out, dtype=object, index=batch.index)})

    step = max(1, LANES * CHUNK // size)
    kind = dict(parts.dtypes)["id"]
    tops = F.greatest(F.ceil(F.col("size") / F.lit(size)) - 1, F.lit(0)).cast("long")
    narrow = parts.select("id", "source", "size", "part", tops.alias("top"))
    nodes = written(narrow.mapInPandas(run, f"id {kind}, part long, top long, cv binary"), "blake3-parts")
    done, rest = nodes.where("top = 0"), nodes.where("top > 0")
    while rest.limit(1).count():
        # FAN values at most are in a group; an input's last fold is the one that holds all of them
        groups = rest.groupBy("id", "top", F.floor(F.col("part") / FAN).alias("at")).agg(F.sort_array(F.collect_list(F.struct("part", "cv"))).alias("cvs"))
        up = groups.select("id", F.col("at").alias("part"), F.floor(F.col("top") / FAN).alias("top"), (F.col("top") < FAN).alias("last"), "cvs").mapInPandas(fold, f"id {kind}, part long, top long, cv binary")
        up = written(up, "blake3-nodes")
        done, rest = done.unionByName(up.where("top = 0")), up.where("top > 0")
    return done.select("id", F.lower(F.hex("cv")).alias("hash"))


def _range(path: str, first: int, n: int) -> bytes | None:
    try:
        with open(path, "rb") as f:
            f.seek(first)
            return f.read(n)
    except (OSError, TypeError):
        return None


def hash_large(files: DataFrame, part_chunks: int = PART_CHUNKS, path: str = "abs_path") -> DataFrame:
    """(id, hash): BLAKE3 of files (id, path, size_bytes), each read by as many tasks as it has parts; null if a part can't be read or the file has another size now."""
    top = F.greatest(F.ceil(F.col("size_bytes") / F.lit(part_chunks * CHUNK)) - 1, F.lit(0)).cast("long")
    parts = files.select("id", F.col(path).alias("source"), F.col("size_bytes").cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("part"))
    return blake3_in_parts(parts.repartition("id", "part"), _range, part_chunks)


def blake3_of_texts(rows: DataFrame, id_: str, text: str, part_chunks: int) -> DataFrame:
    """(id, hash): BLAKE3 of a column's texts or bytes, cut into parts before Python sees them; null for null."""
    size = part_chunks * CHUNK
    bytes_ = rows.select(F.col(id_).alias("id"), F.col(text).cast("binary").alias("b"))
    top = F.greatest(F.ceil(F.octet_length("b") / F.lit(size)) - 1, F.lit(0)).cast("long")
    parts = bytes_.where("b is not null").select("id", "b", F.octet_length("b").cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("part"))
    cut = parts.select("id", F.substring("b", F.col("part") * size + 1, F.lit(size)).alias("source"), "size", "part")
    found = blake3_in_parts(cut, lambda data, first, n: bytes(data), part_chunks)
    return found.unionByName(bytes_.where("b is null").select("id", F.lit(None).cast("string").alias("hash")))


def with_missing_hashes(files: DataFrame, algorithm: str, rehash: bool = False) -> DataFrame:
    """files with the algorithm's hash column filled where it is null (all, if rehash); the other algorithm's hash stays. Links are not read. Files with an id and a size of LARGE or more get BLAKE3 by parts.

    Only the rows without a hash go through Python."""
    column = {"md5": "md5_hash", "blake3": "blake3_hash"}[algorithm]
    need = (F.col(column).isNull() | F.lit(rehash)) & ~F.coalesce(F.col("is_symlink"), F.lit(False))
    in_parts = algorithm == "blake3" and {"id", "size_bytes"} <= set(files.columns)
    large = F.coalesce(F.col("size_bytes") >= LARGE, F.lit(False)) if in_parts else F.lit(False)
    fresh = hash_files(files.where(need & ~large).drop("error"), algorithm).withColumn(column, F.coalesce("hash", column)).drop("hash")
    out = files.where(~need).unionByName(fresh.select(*files.columns))
    if in_parts:
        parted = written(hash_large(files.where(need & large)), "hash-large")
        out = out.unionByName(files.where(need & large).join(parted, "id", "left").withColumn(column, F.coalesce("hash", column)).select(*files.columns))
    return out


def verify(expected: Column, md5: Column, blake3: Column) -> Column:
    """Whether the hash of the expected one's length is equal to it, letters in either case; an error for other lengths."""
    same = F.when(F.length(expected) == 32, F.lower(expected) == F.lower(md5)).when(F.length(expected) == 64, F.lower(expected) == F.lower(blake3))
    return F.when(F.length(expected).isin(32, 64) | expected.isNull(), same).otherwise(F.raise_error(F.concat(F.lit("no hash has this length: "), expected)).cast("boolean"))


def content_hash(text: Column, algorithm: str = "md5") -> Column:
    """MD5 of a column's text or bytes, in generated code; BLAKE3 of it by batches."""
    if algorithm == "md5":
        return F.md5(text.cast("binary"))

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        known = [bytes(v) for v in x if v is not None]
        found = iter(blake3_of(known))
        return pd.Series([None if v is None else next(found) for v in x], dtype=object)

    return run(text.cast("binary"))
