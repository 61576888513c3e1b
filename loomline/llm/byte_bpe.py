"""Byte-level BPE encoding and decoding by rounds over padded numpy matrices.

A text is split by the pattern. Distinct pieces that aren't tokens themselves are
put into matrices of similar length, one row of token numbers each. In every round
each row merges its leftmost pair of least rank: pairs are looked up in a hash
table of two token numbers, the merged number replaces the left one, and the row
closes the gap, so that all rows of a matrix lose one column a round. Rows without
a pair leave.

A row needs as many rounds as it has merges, so time grows with the square of its
length. Pieces longer than WIDEST bytes are first cut between bytes that no token
has side by side; what is still longer merges in the same order from a heap.

The rank file need not list parts before wholes: every way to put a token together
from two tokens is a pair, as the reference library for these files looks up the joined
bytes. Its Unicode tables may be older than those of the pattern's library, so
characters that only the newer know are classed by asking it.

Defined results: null and empty texts have no tokens and decode to no bytes;
repeated rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_codec import _kept
from .storage import small_batches

WIDEST, CELLS = 512, 1 << 21
#: Pieces and words kept between batches, and the longest of them in characters.
CACHED, CACHED_LENGTH = 500_000, 64
NONE = np.int32(2**31 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def unknown_characters() -> str:
    """Letters and numbers of the pattern's library that the ranks' library has no class for yet."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    pairs = [p + c for c in new for p in "a1"]
    ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + i for i, p in enumerate(pairs)}
    asked = tiktoken.Encoding("classes", pat_str=default_pattern(), mergeable_ranks=ranks, special_tokens={})
    # a pair that the library doesn't split is one token
    whole = [len(asked.encode_ordinary(p)) == 1 for p in pairs]
    return "".join(c for i, c in enumerate(new) if not (whole[2 * i] or whole[2 * i + 1]))


class Splitter:
    """Pieces of texts by the pattern, with characters of unknown class as neither letters nor numbers."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern).findall
        unknown = unknown_characters()
        self.unknown = np.zeros(0x110000, bool)
        self.unknown[[ord(c) for c in unknown]] = True
        if unknown:
            # slow, so only for texts that have such characters
            without = f"[{regex.escape(unknown)}]"
            pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[[\p{{L}}\p{{N}}]--{without}]]")
            pattern = regex.sub(r"(?<!\[)(\\p\{[LN]\})(?!\\p|\])", lambda m: f"[{m[1]}--{without}]", pattern)
            self.exact = regex.compile(pattern, regex.V1).findall

    def has_unknown(self, text: str) -> bool:
        return not text.isascii() and self.unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()

    def __call__(self, text: str) -> list[str]:
        return self.exact(text) if self.has_unknown(text) else self.plain(text)


class PairTable:
    """The rank of two token numbers side by side: open addressing, so that whole arrays are looked up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ranks: np.ndarray, size: int):
        self.size, self.bits = np.int64(size), max(4, (4 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        keys = left * self.size + right
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of keys that meet in a slot the last stays
            mine = self.keys[slot] == keys
            self.ranks[slot[mine]] = ranks[mine]
            keys, ranks, slot = keys[~mine], ranks[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE for pairs that don't merge, and where either number is negative."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left * self.size + right).ravel()
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while len(rest):
            slot = (self._slots(keys[rest]) + 1) & ((1 << self.bits) - 1) if len(slot) != len(rest) else (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            rest, slot = rest[on], slot[on]
        return out.reshape(left.shape)


def buckets(lengths: np.ndarray) -> np.ndarray:
    """The width of the matrix for each length: the next multiple of an eighth of the power of two below it, of 4 at least."""
    step = np.maximum(4, 1 << np.maximum(0, np.log2(np.maximum(lengths, 1)).astype(np.int64) - 3))
    return -(-lengths // step) * step


class Codec:
    """The tokens of one rank file, and the pieces encoded so far."""

    def __init__(self, ranks_file: str, pattern: str):
        self.ranks = read_ranks(ranks_file)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = Splitter(pattern)
        halves = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        left, right, merged = np.array(halves, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged.astype(np.int32), len(self.tokens))
        #: Which byte follows which in some token.
        self.follows = np.zeros((256, 256), bool)
        inside = [np.frombuffer(t, np.uint8) for t in self.tokens if len(t) > 1]
        self.follows[np.concatenate([t[:-1] for t in inside]), np.concatenate([t[1:] for t in inside])] = True
        #: No piece of the usual pattern goes on over a space before a character other than white space.
        self.cut_at_spaces = pattern == default_pattern()
        #: The ids of each piece, and of each word with a space before it, as little-endian 32-bit integers.
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one bucket."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            if ranks.shape[1]:
                best = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), best]
                on = least != NONE
            else:
                on = np.zeros(len(rows), bool)
            if not on.all():
                done = ids[~on]
                used = done >= 0
                flat, ends = done[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(1))).tolist()
                for row, start, end in zip(rows[~on].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[row] = flat[start:end]
                if not on.any():
                    break
                rows, ids, ranks, best, least = rows[on], ids[on], ranks[on], best[on], least[on]
            at = np.arange(len(rows))
            keep = np.ones(ids.shape, bool)
            ids[at, best], keep[at, best + 1] = least, False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[at, best] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            for there, left in ((best > 0, best - 1), (best < ranks.shape[1], best)):
                r, c = at[there], left[there]
                ranks[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])
        return out

    def _heap(self, piece: bytes) -> bytes:
        """Ids of one long piece: the least rank first, the leftmost of equals, from a heap."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.pairs.find(ids[:-1], ids[1:])
        at = np.flatnonzero(first != NONE)
        heap = list(zip(first[at].tolist(), at.tolist(), strict=True))
        heapify(heap)
        current, ids = first.tolist() + [int(NONE)], ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, rank_of, none = self.tokens, self.ranks.get, int(NONE)
        while heap:
            rank, i = heappop(heap)
            if current[i] != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], current[gone] = rank, -1, none
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    new = none if right >= n else rank_of(tokens[ids[left]] + tokens[ids[right]], none)
                    current[left] = new
                    if new != none:
                        heappush(heap, (new, left))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that are no tokens."""
        short, place, out = [], [], [b""] * len(pieces)
        for i, piece in enumerate(pieces):
            if len(piece) <= WIDEST:
                short.append(piece)
                place.append(i)
                continue
            codes = np.frombuffer(piece, np.uint8)
            cuts = (np.flatnonzero(~self.follows[codes[:-1], codes[1:]]) + 1).tolist()
            parts = [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]
            small = sorted({p for p in parts if len(p) <= WIDEST})
            known = dict(zip(small, self._merged(small), strict=True))
            out[i] = b"".join(known[p] if p in known else self._heap(p) for p in parts)
        if short:
            widths = buckets(np.fromiter(map(len, short), np.int64, len(short)))
            order = np.argsort(widths, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(widths[order])) + 1).tolist(), len(short)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                step = max(1, CELLS // int(widths[order[start]]))
                for at in range(start, end, step):
                    own = order[at : min(at + step, end)].tolist()
                    for i, ids in zip(own, self._matrix([short[i] for i in own]), strict=True):
                        out[place[i]] = ids
        return out

    def _known_pieces(self, pieces: set[str]) -> None:
        """Put the ids of all pieces into self.pieces."""
        if len(self.pieces) + len(pieces) > CACHED:
            self.pieces = {p: self.pieces[p] for p in pieces & self.pieces.keys()}
        names, raw = [], []
        for p in pieces - self.pieces.keys():
            code = p.encode()
            if (rank := self.ranks.get(code)) is not None:
                self.pieces[p] = rank.to_bytes(4, "little")
            else:
                names.append(p)
                raw.append(code)
        self.pieces.update(zip(names, self._merged(raw), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = self.cut_at_spaces
        words = [[] if not t else t.split(" ") if cut and not self.split.has_unknown(t) else [t] for t in texts]
        new = set(chain.from_iterable(w[1:] for w in words))
        if len(self.words) + len(new) > CACHED:
            self.words = {w: self.words[w] for w in new & self.words.keys()}
        new -= self.words.keys()
        # a space before white space is no place to cut: such texts are split as a whole
        odd = {w for w in new if not w or w[0].isspace()}
        if odd:
            words = [w if odd.isdisjoint(w[1:]) else [t] for w, t in zip(words, texts, strict=True)]
        heads = [self.split(w[0]) if w else [] for w in words]
        # only the first piece of a word starts with a space
        new = list(new - odd)
        pieces = self.split.plain(" " + " ".join(new)) if new else []
        self._known_pieces(set(chain(pieces, chain.from_iterable(heads))))
        known, word = self.pieces.__getitem__, self.words.__getitem__
        ids = list(map(known, pieces))
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        for w, (i, j) in zip(new, pairwise([*starts, len(pieces)]), strict=True):
            self.words[w] = ids[i] if j == i + 1 else b"".join(ids[i:j])
        out = [np.frombuffer(b"".join(chain(map(known, h), map(word, w[1:]))), "<u4") for h, w in zip(heads, words, strict=True)]
        for cache, seen in ((self.words, new), (self.pieces, chain(pieces, chain.from_iterable(heads)))):
            for p in [p for p in seen if len(p) > CACHED_LENGTH]:
                cache.pop(p, None)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    """One for each worker process, rank file and pattern."""
    if (ranks_file, pattern) not in _codecs:
        _codecs[ranks_file, pattern] = Codec(ranks_file, pattern)
    return _codecs[ranks_file, pattern]


def encode_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns in keep, n_tokens and ids for each row of docs; a kept column named like one of the two becomes input_<name>."""
    ranks_file, pattern = ranks_file or default_ranks(), pattern or default_pattern()
    small_batches(docs.sparkSession)
    docs = _kept(docs, keep, ("n_tokens", "ids"), F.col(text_col).alias("text_to_encode"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for batch in batches:
            ids = c.encode(batch.column(batch.num_columns - 1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *(i.astype(np.int32) for i in ids)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets), pa.int64()), lists], [*batch.schema.names[:-1], "n_tokens", "ids"])

    return docs.mapInArrow(run, ", ".join([*fields, "n_tokens long", "ids array<int>"]))


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns in keep and text for each row of encoded, null ids giving an empty text; a kept column named text becomes input_text."""
    ranks_file, pattern = ranks_file or default_ranks(), pattern or default_pattern()
    encoded = _kept(encoded, keep, ("text",), F.col(ids_col).alias("ids_to_decode"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for batch in batches:
            texts = [c.decode(np.array(i or [], np.int64)).decode("utf-8", "replace") for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return encoded.mapInArrow(run, ", ".join([*fields, "text string"]))


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: of the ids as little-endian 32-bit integers, and of the bytes that they decode to."""
    ranks_file, pattern = ranks_file or default_ranks(), pattern or default_pattern()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for batch in batches:
            ids = c.encode(batch.column("text").to_pylist())
            columns = [[len(i) for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(c.decode(i)).hexdigest() for i in ids]]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_query(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
