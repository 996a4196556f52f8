"""SentencePiece BPE by a table of last tokens.

The encoding of every prefix of a text has one last token. An automaton names the pieces that end at a place;
of these, the last token is the one whose piece joins compatibly with the last token of the prefix before it: two
pieces are compatible if the merges of both, run side by side, never join across the seam. So one pass from left to right
fills the table, and a walk backwards along it recovers the ids. Both take time linear in the text, and no
merge is ever run on a text itself. Short spans fill their tables together, place by place in numpy.

Why this is exact: merges take the pair of the best score, then the leftmost. Up to the first merge across
a seam both sides evolve as if alone, so a row of pieces whose neighbours are all compatible is the text's encoding.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: How the model writes a blank.
BLANK = "▁"
#: A character that is no piece, as a last token; it becomes its bytes.
UNKNOWN = -1
#: Spans and pairs that a worker remembers before it starts afresh: bounds of its memory, at about 75 and 40 MB.
SPANS, PAIRS = 300_000, 300_000
#: Characters of a span that fills its table with others; longer ones do so alone and are not remembered.
SHORT = 48
#: Characters of text whose spans are taken together.
BLOCK = 1 << 20


class PieceModel:
    """Encodes and decodes by one model file: BPE with byte fallback, blanks marked, one blank put before a text.

    Models that normalise otherwise, or hold unused or partly unknown pieces, are refused with a ValueError.
    """

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        known = {p for p in self.score if len(p) == 1}
        if any(map(sp.is_unused, range(n))) or sp.normalize("  a  b\n ") != f"{BLANK * 3}a {BLANK}b\n{BLANK}" or not all(set(p) <= known for p in self.score):
            raise ValueError(f"{model}: this kind of model is not supported")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single = np.full(sys.maxunicode + 1, UNKNOWN, np.int32)
        for i, p in self.piece.items():
            if len(p) == 1:
                self.single[ord(p)] = i  # the last token where no longer piece is
            else:
                self.automaton.add_word(p, i << 8 | len(p))
        self.automaton.make_automaton()
        self.size = np.zeros(n, np.int64)
        self.size[plain] = [len(self.piece[i]) for i in plain]
        self.outside = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in known)
        self.steps: dict[int, tuple | None] = {}
        self.pairs = _Pairs(self)
        self.spans: dict[str, bytes] = {}
        # spans end where no piece crosses: before blanks, around characters of no longer piece, behind words that some signs follow
        ascii = [c for c in map(chr, range(128)) if c != BLANK]
        inside = set("".join(p for p in self.score if len(p) > 1))
        behind = {c for p in self.score for w, c in zip(p, p[1:]) if w.isalnum()}
        alone = "".join(re.escape(c) for c in ascii if c not in inside)
        signs = "".join(re.escape(c) for c in ascii if c not in behind and not c.isalnum())
        word = f"{BLANK}*[^\\W_{alone}]+(?=[{BLANK}{alone}{signs}]|\\Z)|"
        self.split = re.compile("(?s).+" if BLANK in behind or any(BLANK in p.lstrip(BLANK) for p in self.score) else f"{word}{BLANK}*[^{BLANK}{alone}]+|{BLANK}+|(?s:.)").findall
        # what each id decodes to; control ids have no bytes
        self.bytes = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        for i, p in self.piece.items():
            self.bytes[i] = p.replace(BLANK, " ").encode("utf-8", "surrogatepass")
        self.control = {i for i in range(n) if sp.is_control(i)}

    def merges(self, i: int) -> tuple | None:
        """The merges that make piece i out of its characters, in order: for each edge its first character and
        [(negated score, symbol at the edge after it)]; None for a piece whose own text becomes something else."""
        if i not in self.steps:
            s, left, right = list(self.piece[i]), [], []
            first = s[0], s[-1]
            while len(s) > 1:
                best = min(((-self.score[a + b], k) for k, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.score), default=None)
                if best is None:
                    break
                s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]
                left.append((best[0], s[0]))
                right.append((best[0], s[-1]))
            self.steps[i] = (first[0], left, first[1], right) if len(s) == 1 else None
        return self.steps[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of piece a followed by that of piece b becomes just these two."""
        m, n = self.merges(a), self.merges(b)
        if m is None or n is None:
            return False
        x, y, i, j, never = m[2], n[0], 0, 0, float("inf")
        while True:
            next_a = m[3][i][0] if i < len(m[3]) else never
            next_b = n[1][j][0] if j < len(n[1]) else never
            across = self.score.get(x + y)
            # of equal scores the leftmost pair comes first: that of a, then the one across
            if across is not None and -across < next_a and -across <= next_b:
                return False
            if next_a == next_b == never:
                return True
            if next_a <= next_b:
                x, i = m[3][i][1], i + 1
            else:
                y, j = n[1][j][1], j + 1

    def _singles(self, s: str) -> np.ndarray:
        return self.single[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def long_span(self, s: str) -> np.ndarray:
        """The ids of one span: its table of last tokens, then back along it."""
        last, pairs = self._singles(s).tolist(), self.pairs
        for end, v in self.automaton.iter(s):
            n = v & 255
            if pairs[(last[end - n] if end >= n else UNKNOWN) + 1 << 20 | v >> 8]:
                last[end] = v >> 8
        ids, at = [], len(s) - 1
        while at >= 0:
            if (i := last[at]) == UNKNOWN:
                ids += [self.byte[b] for b in reversed(s[at].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                ids.append(i)
                at -= len(self.piece[i])
        return np.array(ids[::-1], np.int32)

    def short_spans(self, spans: list[str]) -> list[bytes]:
        """The ids of each span, all tables filled place by place at once."""
        size = np.array([len(s) for s in spans])
        begin = np.cumsum(size + 1) - size  # places in the joined text, which begins with a separator
        joined = self.outside + self.outside.join(spans)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64)
        end, token, n = hits[::2], hits[1::2] >> 8, hits[1::2] & 255
        place = end - np.repeat(begin, size + 1)[end - 1]
        order = np.argsort(place.astype(np.int16), kind="stable")
        end, token, n = end[order], token[order], n[order]
        cuts = np.searchsorted(place[order], np.arange(size.max() + 1))
        last = self._singles(joined)
        for a, b in zip(cuts, [*cuts[1:], len(end)]):
            key, at = np.unique(last[end[a:b] - n[a:b]].astype(np.int64) + 1 << 20 | token[a:b], return_inverse=True)
            ok = np.fromiter(map(self.pairs.__getitem__, key.tolist()), bool, len(key))[at]
            last[end[a:b][ok]] = token[a:b][ok]
        chosen, strange = np.zeros(len(joined), bool), np.zeros(len(spans), bool)
        w, at = np.arange(len(spans)), begin + size - 1
        while len(w):
            chosen[at] = True
            strange[w] |= last[at] == UNKNOWN
            at = at - self.size[last[at]]
            on = (at >= begin[w]) & ~strange[w]
            w, at = w[on], at[on]
        ids = last[chosen]
        to = np.cumsum(chosen)[begin + size - 1]
        raw, out = ids.tobytes(), []
        for s, b, a, odd in zip(spans, (4 * to).tolist(), [0, *(4 * to[:-1]).tolist()], strange.tolist()):
            out.append(self.long_span(s).tobytes() if odd else raw[a:b])
        return out

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text and the end id; an empty text and a null have the end id alone."""
        for a, b in _blocks(texts):
            rows = [self.split(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts[a:b]]
            own = set(chain.from_iterable(rows))
            if len(self.spans) + len(own) > SPANS:
                self.spans.clear()
            new = [s for s in own if s not in self.spans]
            short = [s for s in new if len(s) <= SHORT]
            if short:
                self.spans.update(zip(short, self.short_spans(short)))
            long = {s: self.long_span(s).tobytes() for s in new if len(s) > SHORT}
            self.spans |= long
            for row in rows:
                yield np.append(np.frombuffer(b"".join(map(self.spans.__getitem__, row)), np.int32), np.int32(self.end))
            for s in long:
                del self.spans[s]
            if len(self.pairs) > PAIRS:
                self.pairs.clear()

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The blank that begins it is the one that encoding put there; bytes that are no UTF-8
        become one replacement character each."""
        seen = next((i for i in ids if i not in self.control), None)
        put = seen in self.piece and self.piece[seen].startswith(BLANK)
        try:
            text = b"".join(map(self.bytes.__getitem__, ids)).decode()
            whole = self.control.isdisjoint(ids[:-1])  # one inside ends a run of bytes
        except UnicodeDecodeError:
            whole = False
        text = text if whole else "".join(self._broken(ids))
        return text[1:] if put else text

    def _broken(self, ids: list[int]) -> Iterator[str]:
        of, run = {i: b for b, i in enumerate(self.byte)}, bytearray()

        def flushed() -> Iterator[str]:
            at = 0
            while at < len(run):
                for n in range(1, 5):
                    try:
                        yield run[at : at + n].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    yield "�"
                at += n
            run.clear()

        for i in ids:
            if i in of:
                run.append(of[i])
            else:
                yield from flushed()
                yield self.bytes[i].decode("utf-8", "surrogatepass")
        yield from flushed()


class _Pairs(dict):
    """(last token + 1) << 20 | token: whether the two are compatible; with no last token, whether the token keeps to itself."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, key: int) -> bool:
        a, b = (key >> 20) - 1, key & (1 << 20) - 1
        self[key] = ok = self.model.merges(b) is not None if a == UNKNOWN else self.model.compatible(a, b)
        return ok


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    """One model a worker, kept for its later partitions."""
    return PieceModel(path)


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The columns of ``docs`` and ``ids`` (array<int>, the end id last), ``decoded`` (string: the ids decoded again).

    Columns of these names in ``docs`` are replaced, whatever their case; all others pass through. A null text is encoded as an empty one. Whole
    texts are encoded in time linear in their length. Repeated rows stay, an empty table gives an empty one. No row moves between
    partitions, so no order or tie is involved.
    """

    @F.pandas_udf("ids array<int>, decoded string")
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = piece_model(model)
        for s in texts:
            own = [t if isinstance(t, str) else None for t in s]
            for a, b in _blocks(own):
                ids = list(m.encode(own[a:b]))
                yield pd.DataFrame({"ids": ids, "decoded": [m.decode(x.tolist()) for x in ids]})

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "decoded")]
    own = F.struct(*rest).alias("row") if rest else F.lit(None).alias("row")
    made = docs.select(own, each(F.col(text_col).cast("string")).alias("made"))
    return made.select("row.*", "made.*") if rest else made.select("made.*")


def op11_pieces(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``."""
    d = encode(docs.select("doc_id", "text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
