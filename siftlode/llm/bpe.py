"""Byte-level BPE by the ranks of a public vocabulary, contracted by recursive SQL in each partition.

Every Python worker holds an in-memory DuckDB with two tables: the vocabulary, and all pairs of tokens whose
bytes join to a token. The distinct pieces of a block become token-position rows; a recursive query joins
neighbours with the pair table and contracts each piece's leftmost pair of least rank until none is left.
An ordered aggregation of the bytes of each document's ids decodes. Pieces over LONG bytes are contracted in
the same order with a heap: the recursion keeps a row for each position and merge, so its memory grows with
the square of a piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import unused

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes up to which pieces are contracted in SQL.
LONG = 1024
#: Pieces of one recursive query, and the sum of their squared bytes: the query keeps a state for each merge.
AT_ONCE, SQUARES = 8_000, 2 << 20
#: Pieces that a worker remembers before it starts afresh; bounds its memory at about 80 MB.
REMEMBERED = 320_000
#: Bytes of text taken at a time.
BLOCK = 2 << 20
#: Ids decoded by one aggregation; longer runs are decoded in parts, which bounds its memory.
DECODED = 1 << 18

# A token knows the next one (np, nid); key is rank, place and next place of the pair in one number, so that its
# minimum names all three. Only the contracted token and the one before it look their pair up again.
_CONTRACT = """
WITH RECURSIVE s(step, w, p, np, id, nid, key) AS (
  SELECT 0::SMALLINT, w, p, np, x.id, nid, (pairs.id::BIGINT << 32) + (p::BIGINT << 16) + np
  FROM (SELECT w, p, id, lead(p) OVER o AS np, lead(id) OVER o AS nid FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)) x
  LEFT JOIN pairs ON a = x.id AND b = nid
  UNION ALL
  SELECT step, w, p, np, y.id, nid, CASE WHEN fresh THEN (pairs.id::BIGINT << 32) + (p::BIGINT << 16) + np ELSE key END
  FROM (SELECT s.step + 1::SMALLINT AS step, s.w, s.p, s.key,
               CASE WHEN s.p = m.p THEN m.np ELSE s.np END AS np,
               CASE WHEN s.p = m.p THEN made ELSE s.id END AS id,
               CASE WHEN s.p = m.p THEN m.nid WHEN s.np = m.p THEN made ELSE s.nid END AS nid,
               s.p = m.p OR coalesce(s.np = m.p, false) AS fresh
        FROM s JOIN (SELECT b.w, (best >> 32)::INT AS made, ((best >> 16) & 65535)::INT AS p, gone.p AS gone, gone.np, gone.nid
                     FROM (SELECT w, min(key) AS best FROM s GROUP BY w HAVING best IS NOT NULL) b
                     JOIN s gone ON gone.w = b.w AND gone.p = best & 65535) m ON m.w = s.w AND s.p <> gone) y
  LEFT JOIN pairs ON a = CASE WHEN fresh THEN y.id END AND b = nid)
SELECT s.w, p, id FROM s JOIN (SELECT w, max(step) AS last FROM s GROUP BY w) e ON e.w = s.w AND step = last ORDER BY s.w, p
"""


class Codec:
    """Encodes and decodes by one file of ranks (``base64 rank`` lines); special tokens do not exist."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "160MB"})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = np.array(pairs, np.int32).T
        own = pa.table({"a": a, "b": b, "id": r})
        self.db.execute("CREATE TABLE pairs AS SELECT * FROM own")
        # DuckDB aggregates strings, so a byte is held as the character of its number
        words = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "t": [k.decode("latin-1") for k in self.ranks]})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = _Numbered()
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [self._long(p) if len(p) > LONG else self.byte[:0] for p in pieces]
        for short in self._batches([i for i, p in enumerate(pieces) if 0 < len(p) <= LONG], pieces):
            n = np.array([len(pieces[i]) for i in short])
            w = np.repeat(np.arange(len(short), dtype=np.int32), n)
            p = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            tokens = pa.table({"w": w, "p": p, "id": self.byte[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]})  # noqa: F841
            got = self.db.execute(_CONTRACT).fetchnumpy()
            cuts = np.searchsorted(got["w"], np.arange(1, len(short)))
            for i, ids in zip(short, np.split(np.asarray(got["id"], np.int32), cuts)):
                out[i] = ids
        return out

    def _batches(self, every: list[int], pieces: list[bytes]) -> Iterator[list[int]]:
        a = squares = 0
        for b, i in enumerate(every):
            n = len(pieces[i]) ** 2
            if b > a and (b - a == AT_ONCE or squares + n > SQUARES):
                yield every[a:b]
                a, squares = b, 0
            squares += n
        if every:
            yield every[a:]

    def _long(self, piece: bytes) -> np.ndarray:
        part, n = [piece[i : i + 1] for i in range(len(piece))], len(piece)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = lambda i: self.ranks.get(part[i] + part[after[i]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            part[i] += part[j]
            alive[j], after[i] = False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([self.ranks[p] for p, a in zip(part, alive) if a], np.int32)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out: list[list[bytes]] = [[] for _ in ids]
        w = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        for a in range(0, len(flat), DECODED):
            part = slice(a, a + DECODED)
            own = pa.table({"w": w[part], "p": np.arange(len(w[part])), "id": flat[part]})  # noqa: F841
            for i, t in self.db.execute("SELECT w, string_agg(t, '' ORDER BY p) FROM own JOIN vocabulary USING (id) GROUP BY w").fetchall():
                out[i].append(t.encode("latin-1"))
        return list(map(b"".join, out))

    def learn(self) -> None:
        """Contracts the pieces that were met since the last call."""
        ids = self.contract([p.encode("utf-8", "surrogatepass") for p in self.known.new])
        n = np.array([len(x) for x in ids], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.ids = np.concatenate([self.ids, *ids])
        self.known.new.clear()

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids of each text, and the bytes that all its ids decode to."""
        split, get = self.pattern.findall, self.known.__getitem__
        rows = [np.fromiter(map(get, split(t or "")), np.int64) for t in texts]
        if self.known.new:
            self.learn()
        for i, row in enumerate(rows):
            n = self.length[row]
            at = np.repeat(self.start[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows[i] = self.ids[at]
        if len(self.known) > REMEMBERED:
            self.forget()
        yield from zip(rows, self.decode(rows))


class _Numbered(dict):
    """Numbers its keys as they are first asked for, and lists them."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


@lru_cache(2)
def codec(ranks: str, pattern: str) -> Codec:
    """One codec a worker, kept for its later partitions."""
    return Codec(ranks, pattern)


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK:
            yield slice(a, i + 1)
            a, size = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def encode(docs: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns of ``docs`` and ``ids`` (array<int>), ``decoded`` (binary: the ids decoded again).

    Columns of these names in ``docs`` are replaced. A null text is encoded as an empty one. Whole texts are
    encoded, each match of the pattern by itself. Repeated rows stay, an empty table gives an empty one. No row moves
    between partitions.
    """

    @F.pandas_udf("ids array<int>, decoded binary")
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(ranks, pattern)
        for s in texts:
            t = [x if isinstance(x, str) else None for x in s]
            for b in _blocks(t):
                ids, decoded = zip(*c.texts(t[b]))
                yield pd.DataFrame({"ids": ids, "decoded": decoded})

    rest = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    (made,) = unused(docs, "made")
    return docs.select(*rest, each(F.col(text_col).cast("string")).alias(made)).select(*rest, F.col(made)["ids"].alias("ids"), F.col(made)["decoded"].alias("decoded"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, digested where it is made."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks, pattern)
        for pdf in batches:
            t = [x if isinstance(x, str) else None for x in pdf["t"]]
            for b in _blocks(t):
                out = [(len(i), hashlib.sha256(i.astype("<u4")).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in c.texts(t[b])]
                made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                yield pd.concat([pdf[["id"]][b].reset_index(drop=True), made], axis=1)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(each, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``."""
    return digests(docs).withColumnRenamed("id", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents, their ids, and whether the ids decode to the text."""
    d = encode(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return d.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": F.col("decoded") == text}).drop("decoded")
