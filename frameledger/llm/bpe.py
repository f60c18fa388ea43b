"""Byte-pair encoding and decoding with a pair occurrence index.

Texts of a partition are cut into words. The words not met before are laid out as one symbol
sequence; an index maps every adjacent pair that has a rank to all its positions. Ranks are applied
in ascending order, each to all positions of its pair, and the lists of the neighbouring pairs that
a merge makes are updated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space as Unicode's White_Space property has it (fixed values of the tokenizer's \s).
_SPACE = "\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Words of the vocabulary file's Split pre-tokenizer (fixed pattern).
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_GAPS = regex.compile(f"[{_SPACE}]+")
#: Python's split() takes these for white space, the tokenizer doesn't.
_CONTROLS = re.compile("[\x1c-\x1f]")
WORD_END = "</w>"
#: Runs of characters remembered from one batch to the next.
CACHE_RUNS = 120_000


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Position lists at least this long are merged as arrays.
MANY = 192


class PairIndex:
    """Applies the merges of a vocabulary to many words at once.

    Symbols lie in one flat sequence with links to the next and the previous live one. ``where``
    maps an active rank to the positions of its pair; lists may hold positions that have changed
    since, which are passed over.
    """

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], inner: list[int], last: list[int]):
        """ranks: pair to (rank, merged symbol); inner and last: byte to symbol inside a word and at its end."""
        self.by_pair = {a << 32 | b: rank for (a, b), (rank, _) in ranks.items()}
        self.merges = {rank: (a, b, made) for (a, b), (rank, made) in ranks.items()}
        pairs = sorted(self.by_pair.items())
        self.pairs = np.array([p for p, _ in pairs], dtype=np.int64)
        self.ranks = np.array([r for _, r in pairs], dtype=np.int64)
        self.inner, self.last = np.array(inner, dtype=np.int64), np.array(last, dtype=np.int64)
        lowest: dict[int, int] = {}
        for (a, b), (rank, _) in ranks.items():
            for s in (a, b):
                lowest[s] = min(rank, lowest.get(s, rank))
        #: Ranks whose merged symbol has a pair of lower rank, which then goes first in its word.
        self.early = {rank for rank, (_, _, made) in self.merges.items() if lowest.get(made, rank) < rank}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, packed as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat = self.inner[data]
        flat[ends - 1] = self.last[data[ends - 1]]
        next_ = np.arange(1, len(flat) + 1)
        next_[ends - 1] = -1
        prev = np.arange(-1, len(flat) - 1)
        prev[ends - lengths] = -1
        sym, ahead, back = (array("q", x.tobytes()) for x in (flat, next_, prev))  # quick to read one by one
        vsym, vahead, vback = (np.frombuffer(x, dtype=np.int64) for x in (sym, ahead, back))  # the same memory as arrays
        where: dict[int, list] = {}
        active: list[int] = []

        def add(found: np.ndarray, spots: np.ndarray) -> None:
            has = found >= 0
            found, spots = found[has], spots[has]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            found, spots = found[order], spots[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for rank, some in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(spots, cuts), strict=True):
                if rank not in where:
                    where[rank] = []
                    heapq.heappush(active, rank)
                if len(some) < 16:
                    where[rank] += some.tolist()
                else:
                    where[rank].append(some)

        inside = np.flatnonzero(next_ >= 0)
        add(self._rank(flat[inside], flat[inside + 1]), inside)
        by_pair = self.by_pair
        while active:
            rank = heapq.heappop(active)
            parts = where.pop(rank, None)
            if parts is None:
                continue
            a, b, made = self.merges[rank]
            arrays = [x for x in parts if isinstance(x, np.ndarray)]
            spots: list[int] = [x for x in parts if not isinstance(x, np.ndarray)]
            if len(spots) + sum(map(len, arrays)) >= MANY and a != b and rank not in self.early:
                p = np.concatenate([*arrays, np.array(spots, dtype=np.int64)])
                p = p[vsym[p] == a]
                q = vahead[p]
                fits = q >= 0
                p, q = p[fits], q[fits]
                fits = vsym[q] == b
                p, q = p[fits], q[fits]
                vsym[p], vsym[q] = made, -1
                n = vahead[q]
                vahead[p] = n
                right = n >= 0
                vback[n[right]] = p[right]
                add(self._rank(np.full(int(right.sum()), made), vsym[n[right]]), p[right])
                o = vback[p]
                o = o[o >= 0]
                add(self._rank(vsym[o], np.full(len(o), made)), o)
                continue
            for x in arrays:
                spots += x.tolist()
            spots.sort()
            for at, p in enumerate(spots):
                q = ahead[p]
                if sym[p] != a or q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = made, -1
                n, o = ahead[q], back[p]
                ahead[p] = n
                lower = False
                if n >= 0:
                    back[n] = p
                    if (new := by_pair.get(made << 32 | sym[n])) is not None:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(active, new)
                        where[new].append(p)
                        lower = new < rank
                if o >= 0 and (new := by_pair.get(sym[o] << 32 | made)) is not None:
                    if new not in where:
                        where[new] = []
                        heapq.heappush(active, new)
                    where[new].append(o)
                    lower = lower or new < rank
                if lower:  # a pair of lower rank goes before this one's other places
                    rest = where.setdefault(rank, [])
                    rest += spots[at + 1 :]
                    heapq.heappush(active, rank)
                    break
        live = vsym >= 0
        packed = vsym[live].astype("<u4").tobytes()
        to = (np.cumsum(live)[ends - 1] * 4).tolist()
        return [packed[i:j] for i, j in zip([0, *to[:-1]], to, strict=True)]


class WordBpe:
    """Encoder and decoder for a vocabulary file of the word-end kind: NFC, lower case, white space dropped."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        byte = byte_symbols()
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ranks[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.index = PairIndex(ranks, [vocab[c] for c in byte], [vocab[c + WORD_END] for c in byte])
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _runs(self, text: str) -> list[str]:
        """Runs without white space, and special tokens marked with a leading space."""
        found: list[str] = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                found.append(" " + part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()  # a sigma doesn't look at its place
                found += _GAPS.split(part) if _CONTROLS.search(part) else part.split()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        lists = [self._runs(t) for t in texts]
        if len(self.runs) > CACHE_RUNS:
            self.runs.clear()
            self.words.clear()
        runs, words = self.runs, self.words
        for special, i in self.special.items():
            runs[" " + special] = i.to_bytes(4, "little")
        known = [list(map(runs.get, rs)) for rs in lists]
        unseen = {r for rs, got in zip(lists, known, strict=True) if None in got for r, x in zip(rs, got, strict=True) if x is None}
        cut = {r: _WORDS.findall(r) for r in unseen}
        new = list({w: None for ws in cut.values() for w in ws if w not in words})
        words.update(zip(new, self.index.encode([w.encode() for w in new]), strict=True))
        for r, ws in cut.items():
            runs[r] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        return [b"".join([runs[r] if x is None else x for r, x in zip(rs, got, strict=True)] if None in got else got) for rs, got in zip(lists, known, strict=True)]

    def decode(self, packed: bytes) -> str:
        """The tokens' strings with a space between, as the file without a decoder asks for."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


_LOADED: dict[int, WordBpe] = {}
TEXTS_AT_ONCE_CHARS = 2 << 20


def _loaded(content: str) -> WordBpe:
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(content)
    return _LOADED[key]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > TEXTS_AT_ONCE_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """The vocabulary file's text; its size doesn't depend on the corpus."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row (``id_col``, n_tokens, ids[, decoded]): ``ids`` packs little-endian unsigned 32-bit ids.

    ``vocabulary`` is the file's content. Whole texts are encoded; null and empty ones have no
    tokens. Special tokens' strings in a text count as those tokens. With ``decoded`` the ids are
    decoded again. Repeated rows, null ids and further columns are kept apart or ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of a few MB

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in rows:
            at = 0
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                packed = bpe.encode(group)
                columns = [batch.column(0).slice(at, len(group)), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids", "decoded"][: len(columns)])
                at += len(group)

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Packed ids back to (``id_col``, decoded); null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(p or b"") for p in batch.column(1).to_pylist()], pa.string())], names=["id", "decoded"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, decoded string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame) -> DataFrame:
    encoded = encode(docs, read_vocabulary(docs.sparkSession, vocabulary_path()), decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
