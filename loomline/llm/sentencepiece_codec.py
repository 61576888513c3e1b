"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut between characters that no piece has side by side. Distinct stretches of equal length
form a matrix and advance together, one character at a time. Every substring that
ends there is hashed from prefix sums and probed in the sorted piece keys. Its score
is that of the prefix before it, the piece's own, and a transition of 0 if the prefix's
last piece and it may stand side by side and minus infinity if not; the maximum over
the candidates is stored with its backpointer.

The transition departs from a plain Viterbi: the vocabulary is a merge (BPE) one, for
which adding up piece scores alone gives other pieces than the library. A sequence of pieces is what merging gives if and only if
each neighbouring pair is, so with that transition exactly one path survives at
every position and it equals the library's result. Whether merging the text of two
pieces gives back the two is found once for each pair, by batched merging, and
kept in a hash table.

Defined results: null and empty texts have no pieces and decode to the empty
string; characters without a piece become bytes; a literal U+2581 decodes to a
space, as in the library; repeated rows give equal rows; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, small_batches

MARK = "▁"
CACHED_WORDS = 400_000
_BASE = 0xD1342543DE82EF95
_LOW = (1 << 64) - 1
_NONE = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        t = np.full(n, base & _LOW, np.uint64)
        t[0] = 1
        out.append(np.cumprod(t))
    return out[0], out[1]


def _code_values(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Prefixes:
    """Hashes of all substrings of equally long rows."""

    def __init__(self, codes: np.ndarray):
        m, self.n = codes.shape
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros((m, self.n + 1), np.uint64)
        np.cumsum(_code_values(codes) * up[: self.n], axis=1, out=self.sums[:, 1:])

    def of(self, start: int, end: int) -> np.ndarray:
        return (self.sums[:, end] - self.sums[:, start]) * self.down[start]


class _Pairs:
    """Known answers by pair number: open addressing, so that whole arrays are looked up at once."""

    def __init__(self, bits: int = 18):
        self.bits, self.filled = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it isn't there."""
        slot, out, rest = self._slots(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = slot[hit]
            on = ~hit & (there >= 0)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct, none of them there yet."""
        if 2 * (self.filled + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(max(self.bits, int(4 * len(keys)).bit_length()))
        slot = self._slots(keys)
        self.filled += len(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of keys that meet in a slot the last stays
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


class Codec:
    """The pieces of one model file, and what has been learned about them so far."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(self.size)]
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.surface = [b"" if s else p.encode() for p, s in zip(names, special, strict=True)]
        for b, i in enumerate(self.bytes.tolist()):
            self.surface[i] = bytes([b])
        self.text = {i: p for i, (p, s) in enumerate(zip(names, special, strict=True)) if not s}
        keys, ids = [], []
        by_length: dict[int, list[int]] = {}
        for i, p in self.text.items():
            by_length.setdefault(len(p), []).append(i)
        self.longest = max(by_length)
        for own in by_length.values():
            keys.append(_Prefixes(self._codes([self.text[i] for i in own])).of(0, len(self.text[own[0]])))
            ids += own
        keys, ids = np.concatenate(keys), np.array(ids)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        #: Whether some key starts with these 20 bits.
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.score = np.array([model.get_score(i) for i in range(self.size)])
        self.scores = self.score[self.ids]
        pairs = sorted({p[i : i + 2] for p in self.text.values() for i in range(len(p) - 1)})
        chars = sorted({c for p in pairs for c in p})
        number = {c: i + 1 for i, c in enumerate(chars)}
        #: The number of each character that some longer piece has, 0 for others, and which may follow which in a piece.
        self.numbers = np.zeros(0x110000, np.uint16)
        self.numbers[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.follows = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.follows[[number[p[0]] for p in pairs], [number[p[1]] for p in pairs]] = True
        self.pairs = _Pairs()
        #: The ids of each stretch seen, as little-endian 32-bit integers.
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted keys, -1 if it is no piece."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, _NONE)

    def _merged(self, words: list[str]) -> list[tuple[int, ...]]:
        """Starts of the symbols after merging equally long words: always the best score, the leftmost of equals."""
        prefixes = _Prefixes(self._codes(words))
        m, n = len(words), prefixes.n
        out: list[tuple[int, ...]] = [()] * m
        rows, starts = np.arange(m), np.tile(np.arange(n + 1), (m, 1))
        while len(rows):
            k = starts.shape[1] - 1
            if k > 1:
                s, e = starts[:, :-2], starts[:, 2:]
                h = (np.take_along_axis(prefixes.sums[rows], e, 1) - np.take_along_axis(prefixes.sums[rows], s, 1)) * prefixes.down[s]
                at = self._probe(h.ravel()).reshape(h.shape)
                score = np.where(at >= 0, self.scores[at], -np.inf)
                best = score.argmax(1)
                on = score[np.arange(len(rows)), best] > -np.inf
            else:
                on = np.zeros(len(rows), bool)
            for r, s in zip(rows[~on].tolist(), starts[~on].tolist(), strict=True):
                out[r] = tuple(s[:-1])
            if not on.any():
                break
            keep = np.ones((int(on.sum()), k + 1), bool)
            keep[np.arange(len(keep)), best[on] + 1] = False
            rows, starts = rows[on], starts[on][keep].reshape(-1, k)
        return out

    def _side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of left and right gives the two; left -1: of right alone, gives right."""
        keys = (left + 1) * np.int64(self.size) + right
        slot = self.pairs.find(keys)
        if (slot < 0).any():
            new = np.unique(keys[slot < 0])
            by_length: dict[int, list[int]] = {}
            texts = [self.text.get(k // self.size - 1, "") + self.text[k % self.size] for k in new.tolist()]
            for i, t in enumerate(texts):
                by_length.setdefault(len(t), []).append(i)
            good = np.zeros(len(new), bool)
            for own in by_length.values():
                for i, starts in zip(own, self._merged([texts[i] for i in own]), strict=True):
                    first = len(self.text.get(int(new[i]) // self.size - 1, ""))
                    good[i] = starts == ((0, first) if first else (0,))
            self.pairs.add(new, good)
            slot = self.pairs.find(keys)
        return self.pairs.values[slot]

    def _candidates(self, prefixes: _Prefixes) -> tuple[np.ndarray, ...]:
        """Row, start, end and piece of every substring that is a piece, by end."""
        rows, starts, ends, pieces = [], [], [], []
        for length in range(1, min(prefixes.n, self.longest) + 1):
            wide = prefixes.n - length + 1
            h = ((prefixes.sums[:, length:] - prefixes.sums[:, :-length]) * prefixes.down[:wide]).ravel()
            maybe = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
            at = self._probe(h[maybe])
            maybe, at = maybe[at >= 0], at[at >= 0]
            row, start = np.divmod(maybe, wide)
            rows.append(row)
            starts.append(start)
            ends.append(start + length)
            pieces.append(self.ids[at])
        order = np.argsort(np.concatenate(ends), kind="stable")
        return tuple(np.concatenate(x)[order] for x in (rows, starts, ends, pieces))

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Pieces of equally long words."""
        prefixes = _Prefixes(self._codes(words))
        m, n = len(words), prefixes.n
        # a character without a piece stands alone, whatever is before it: last -2
        last, back = np.full((m, n + 1), -2, np.int64), np.ones((m, n + 1), np.int64)
        last[:, 0] = _NONE
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        rows, starts, ends, pieces = self._candidates(prefixes)
        edges = np.searchsorted(ends, np.arange(1, n + 2))
        for end in range(1, n + 1):
            own = slice(edges[end - 1], edges[end])
            row, start, piece = rows[own], starts[own], pieces[own]
            score = np.where(self._side_by_side(np.maximum(last[row, start], _NONE), piece), best[row, start] + self.score[piece], -np.inf)
            np.maximum.at(best[:, end], row, score)
            chosen = (score > -np.inf) & (score == best[row, end])
            row = row[chosen]
            last[row, end], back[row, end] = piece[chosen], end - start[chosen]
            # after a character without a piece, sums go on from what was before it
            lost = np.isneginf(best[:, end])
            best[lost, end] = best[lost, end - 1]
        out, at = np.full((m, n), -1, np.int64), np.full(m, n)
        for place in range(n - 1, -1, -1):
            on = np.flatnonzero(at > 0)
            if not len(on):
                break
            out[on, place] = last[on, at[on]]
            at[on] -= back[on, at[on]]
        used = out != -1
        flat, cuts = out[used].astype("<i4").tobytes(), np.concatenate([[0], 4 * np.cumsum(used.sum(1))]).tolist()
        done = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in np.flatnonzero((out == -2).any(1)).tolist():
            done[i] = self._with_bytes(words[i], done[i])
        return done

    def _with_bytes(self, word: str, line: bytes) -> bytes:
        out, at = [], 0
        for i in np.frombuffer(line, "<i4").tolist():
            if i == -2:
                out += self.bytes[list(word[at].encode("utf-8", "replace"))].tolist()
                at += 1
            else:
                out.append(i)
                at += len(self.text[i])
        return np.array(out, "<i4").tobytes()

    def _stretches(self, text: str | None) -> list[str]:
        """The text with the space mark, cut wherever no piece has the two characters side by side."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        number = self.numbers[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(~self.follows[number[:-1], number[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text."""
        stretches = [self._stretches(t) for t in texts]
        distinct = set(chain.from_iterable(stretches))
        if len(self.words) + len(distinct) > CACHED_WORDS:
            self.words = {w: self.words[w] for w in distinct & self.words.keys()}
        by_length: dict[int, list[str]] = {}
        for w in distinct - self.words.keys():
            by_length.setdefault(len(w), []).append(w)
        for own in by_length.values():
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                self.words.update(zip(part, self._viterbi(part), strict=True))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, s)), "<i4") for s in stretches]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One for each worker process and model."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _kept(df: DataFrame, keep: tuple[str, ...], outputs: tuple[str, ...], value: Column) -> DataFrame:
    """The columns in keep, renamed where an output has their name, and value last."""
    return df.select(*[F.col(f"`{c}`").alias(free_name(df, f"input_{c}") if c.lower() in outputs else c) for c in keep], value)


def encode_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """The columns in keep, n_pieces and ids for each row of docs; a kept column named like one of the two becomes input_<name>."""
    model_file = model_file or default_model()
    small_batches(docs.sparkSession)
    docs = _kept(docs, keep, ("n_pieces", "ids"), F.col(text_col).alias("text_to_encode"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            ids = c.encode(batch.column(batch.num_columns - 1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets), pa.int64()), lists], [*batch.schema.names[:-1], "n_pieces", "ids"])

    return docs.mapInArrow(run, ", ".join([*fields, "n_pieces long", "ids array<int>"]))


def decode_documents(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """The columns in keep and text for each row of encoded; a kept column named text becomes input_text."""
    model_file = model_file or default_model()
    encoded = _kept(encoded, keep, ("text",), F.col(ids_col).alias("ids_to_decode"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts = [c.decode(i or []) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return encoded.mapInArrow(run, ", ".join([*fields, "text string"]))


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, round_trip) for each row: of the ids as little-endian 32-bit integers, and whether they decode to the text."""
    model_file = model_file or default_model()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = c.encode(texts)
            digests = [hashlib.sha256(i).hexdigest() for i in ids]
            same = [c.decode(i.tolist()) == t.replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")


def op7_query(spark, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
