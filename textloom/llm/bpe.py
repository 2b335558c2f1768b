"""Byte-level BPE encoding and decoding in numpy.

Distinct pieces of a batch are encoded together: grouped by length into padded matrices, every row merges its leftmost
pair of the lowest rank each round; ranks of pairs come from an open-addressing hash table and rows are compacted after
each merge. Pieces longer than LONG bytes, where rounds would cost length squared, use a heap over a linked list with
the same rule. Texts are processed whole; batches are cut by bytes, so memory stays bounded.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.shared import gather, give_back, kept_in_worker, slices, table, tidy

LONG, BATCH_BYTES, CACHE_PIECES = 256, 1 << 18, 100_000
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: For this pattern a text may be cut before any single space and around any single line feed between non-spaces
#: without changing its pieces, so that whole words are looked up; other patterns split every text in full.
WORDS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_codecs: dict[bytes, "Codec"] = {}
kept_in_worker.append(_codecs)


class Codec:
    """Encoder and decoder for a rank file (lines `base64 rank`) and a split pattern."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        self.split = regex.compile(pattern).findall
        self.cut = self._words if pattern == WORDS_PATTERN else lambda t: self.split(t)
        self.odd = regex.compile(r"\s\s|^\s|\s\Z").search
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = tokens
        self.token_len = np.array([len(x) for x in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [b"%d " % i for i in range(size)]
        self.digit_len = np.array([len(x) for x in digits], np.int64)
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._hash_table(pairs)
        self._forget()

    def _hash_table(self, pairs: dict[int, int]) -> None:
        """Open addressing with linear probing, filled in numpy rounds."""
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys, vals = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.slot_keys, self.slot_vals = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, _NONE)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.slot_keys[at] == np.uint64(2**64 - 1)
            self.slot_keys[at[free]], self.slot_vals[at[free]] = keys[free], vals[free]
            late = self.slot_keys[at] != keys
            self.slot_vals[at[~late]] = vals[~late]
            keys, vals, at = keys[late], vals[late], (at[late] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The table's pairs and their ranks for plain Python, made when a long piece needs them and forgotten with the pieces."""
        used = self.slot_vals != _NONE
        return dict(zip(self.slot_keys[used].tolist(), self.slot_vals[used].tolist(), strict=True))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE; negative ids (padding) have none."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        at, out = self._slot(keys), np.full(keys.shape, _NONE)
        todo = right >= 0
        for _ in range(self.probes):
            hit = todo & (self.slot_keys[at] == keys)
            out[hit] = self.slot_vals[at[hit]]
            todo &= ~hit & (self.slot_keys[at] != np.uint64(2**64 - 1))
            if not todo.any():
                break
            at = (at + 1) & ((1 << self.bits) - 1)
        return out

    def _forget(self) -> None:
        self.__dict__.pop("pairs", None)
        self.index: dict[str, int] = {}
        self.piece_len, self.piece_at, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_matrix(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: int32 ids, -1 pads the end. Returns all ids, row after row, and the number of ids of each row."""
        who, parts = np.arange(len(rows)), []
        ranks = self.pair_ranks(rows[:, :-1], rows[:, 1:])
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the lowest
            best = ranks[np.arange(len(rows)), at]
            stop = best == _NONE
            if stop.any():
                parts.append((who[stop], rows[stop]))
                rows, ranks, at, best, who = rows[~stop], ranks[~stop], at[~stop], best[~stop], who[~stop]
            if not len(rows):
                break
            n, width = np.arange(len(rows)), rows.shape[1]
            if width == 2:
                rows, ranks = best[:, None], np.full((len(rows), 1), _NONE)
                continue
            cols = np.arange(width - 1)
            rows = np.take_along_axis(rows, cols + (cols > at[:, None]), 1)  # compaction
            rows[n, at] = best
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            some = at < width - 2
            ranks[n[some], at[some]] = self.pair_ranks(best[some], rows[n[some], at[some] + 1])
            some = at > 0
            ranks[n[some], at[some] - 1] = self.pair_ranks(rows[n[some], at[some] - 1], best[some])
        order = np.concatenate([w for w, _ in parts])
        lens = np.concatenate([(r >= 0).sum(1) for _, r in parts])
        flat = np.concatenate([r[r >= 0] for _, r in parts])
        back = np.argsort(order)
        return flat[gather((np.cumsum(lens) - lens)[back], lens[back])], lens[back]

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after the other, and the number of ids of each piece."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, at = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.cumsum(lens) - lens
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0], np.ones(int((whole >= 0).sum()), np.int64))]
        for i in np.flatnonzero((whole < 0) & (lens > LONG)):
            parts.append((np.array([i]), out := self.merge_long(pieces[i]), np.array([len(out)])))
        low = 1
        for width in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG):
            which = np.flatnonzero((whole < 0) & (lens > low) & (lens <= width))
            for k in range(0, len(which), step := (1 << 19) // width):
                part = which[k : k + step]
                rows = np.full((len(part), width), -1, np.int32)
                rows[np.arange(width) < lens[part, None]] = ids[gather(at[part], lens[part])]
                parts.append((part, *self.merge_matrix(rows)))
            low = width
        order, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        flat, back = np.concatenate([p[1] for p in parts]), np.argsort(order)
        return flat[gather((np.cumsum(counts) - counts)[back], counts[back])].astype(np.int32), counts[back]

    def _words(self, text: str) -> list[str]:
        """Stretches of the text whose pieces are those of the text; a leading space stands for itself."""
        if not text or self.odd(text):
            return self.split(text)
        lines = [x.replace(" ", "\0 ").split("\0") for x in text.split("\n")] if "\0" not in text else [self.split(text)]
        for x in lines[1:]:
            lines[0].append("\n")
            lines[0] += x
        return lines[0]

    def _learn(self, unseen: list[str]) -> None:
        """Ids of stretches that are not in the index yet."""
        new = list(dict.fromkeys(unseen))
        parts = [self.split(x) for x in new]
        counts = np.cumsum([0, *map(len, parts)])
        flat = list(chain.from_iterable(parts))
        distinct = {x: i for i, x in enumerate(dict.fromkeys(flat))}
        ids, lens = self.encode_pieces([x.encode("utf-8", "surrogatepass") for x in distinct])
        which = np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.piece_len = np.concatenate([self.piece_len, np.diff(np.concatenate([[0], np.cumsum(lens[which])])[counts])])
        self.flat = np.concatenate([self.flat, ids[gather((np.cumsum(lens) - lens)[which], lens[which])]])
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each text."""
        if len(self.index) > CACHE_PIECES:
            self._forget()
        pieces, counts = [], [0]
        for t in texts:
            pieces += self.cut(t)
            counts.append(len(pieces))
        which = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(late := np.flatnonzero(which < 0)):
            unseen = [pieces[i] for i in late]
            self._learn(unseen)
            which[late] = np.fromiter(map(self.index.__getitem__, unseen), np.int64, len(unseen))
        lens = self.piece_len[which]
        per_text = np.diff(np.concatenate([[0], np.cumsum(lens)])[counts])
        return self.flat[gather(self.piece_at[which], lens)], per_text

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[memoryview]:
        return self._bytes(ids, per_text, self.token_bytes, self.token_at, self.token_len)

    def decimal(self, ids: np.ndarray, per_text: np.ndarray) -> list[memoryview]:
        """Ids in decimal, each followed by a space."""
        return self._bytes(ids, per_text, self.digit_bytes, self.digit_at, self.digit_len)

    @staticmethod
    def _bytes(ids, per_text, flat, at, length) -> list[memoryview]:
        lens = length[ids]
        out = memoryview(flat[gather(at[ids], lens)])
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per_text)])]
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One per Python worker."""
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


#: What `tokenise` can add, with Spark types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}


def tokenise(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], outputs: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of docs and the `outputs` of each whole text; a null text is empty. One row per row, no shuffle.

    An empty table gives no rows; rows that repeat stay; nulls in `keep` stay. The rank file is read on the driver and broadcast: a vocabulary, whose size does not depend on the data.
    Column names in `outputs` win over equal names in docs only if those are not in `keep`; a clash raises ValueError.
    """
    if set(keep) & set(outputs):
        raise ValueError(f"clashing names: {sorted(set(keep) & set(outputs))}")
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    narrow = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + [f"`{x}` {OUTPUTS[x]}" for x in outputs])

    def run(batches):
        own = codec(ranks.value, pattern)
        for batch in batches:
            texts, cols = batch.column(len(keep)), []
            lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
            for a, b in slices(lengths, BATCH_BYTES):
                ids, per = own.encode([x or "" for x in texts.slice(a, b - a).to_pylist()])
                made = {"n_tokens": lambda: per, "ids": lambda: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(ids)), "ids_sha256": lambda: [hashlib.sha256(x[:-1]).hexdigest() for x in own.decimal(ids, per)]}
                if {"decoded", "decoded_sha256"} & set(outputs):
                    back = own.decode(ids, per)
                    made |= {"decoded": lambda: [bytes(x) for x in back], "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in back]}
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                cols += [x if isinstance(x := made[o](), pa.Array) else pa.array(x, _ARROW[o]) for o in outputs]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *outputs])
            del batch, texts, cols  # or they stay until the next one has been read
            give_back()
        own._forget()  # the worker may serve other stages afterwards

    return narrow.mapInArrow(lambda it: tidy(run(it), _codecs), schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"), *vocabulary(), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])
