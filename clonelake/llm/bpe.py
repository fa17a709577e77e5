"""Encoding of texts with a public byte-level BPE tokenizer.

Method: the pieces into which the tokenizer's pattern splits a text are merged by a segment tree over byte positions.
A leaf holds the rank of the pair that starts there, and every inner node the leftmost least rank below it, so the root
names the next merge; a merge changes the leaves of the two live neighbours and of the position it swallows, and
updates the tree in a logarithmic number of points. The trees of many pieces of like length lie in one array and are
merged in step by numpy. In a long piece all pairs of the least rank are merged at once, which gives the same, as a
token's later merges rank above the one that made it. A piece that a worker has met is looked up, so each worker merges a distinct piece once.

The tokenizer file is read on the driver and broadcast; files with other steps than byte-level BPE are refused.

Texts are encoded where they lie: no shuffle, one Arrow column in and one out.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer file; a parameter everywhere, this is only where the public files usually are.
DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"
#: Distinct pieces that a worker remembers, after which it starts anew.
REMEMBERED = 300_000
#: Characters that are split and merged at once; a longer text is taken by itself.
CHUNK = 2_000_000
#: Bytes from which a piece has a tree of its own, and most bytes of a tokenizer file.
LONG, MOST_FILE = 2048, 100_000_000
#: A leaf without a merge.
NONE = np.int64(2**62)


#: Classes of characters that the tokenizer's pattern tells apart.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space of the pattern.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a piece of its own.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point; planes 4 to 16 hold neither letters nor numbers."""
    out = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    out[:0x40000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)]
    out[SPACES] = SPACE
    return out


def split_pieces(text: str, breaks: np.ndarray) -> np.ndarray:
    """Where the pieces of ``text`` begin; ``breaks`` are the beginnings of its parts, over which no piece runs.

    The tokenizer's pattern takes a run of letters, numbers or other characters with one space before it; white space
    before that is a piece; a run of white space at an end is one piece; an apostrophe with an English ending is one.
    """
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, dtype=bool)  # beginnings of parts
    first[breaks[breaks < n]] = True
    first[n] = True
    starts = first[:n].copy()
    starts[0] = True
    starts[1:] |= kind[1:] != kind[:-1]
    # behind white space: its last character leaves the run, and if it is a space it joins what follows
    behind = np.flatnonzero(starts & (kind != SPACE) & ~first[:n])
    behind = behind[kind[behind - 1] == SPACE]
    starts[behind - 1] = True
    joined = behind[points[behind - 1] == 32]
    starts[joined] = False
    # an apostrophe alone that begins a piece, with an ending right behind
    quotes = np.flatnonzero((points == 39) & starts)
    for q in quotes.tolist():
        for e in ENDINGS:
            z = q + 1 + len(e)
            if text.startswith(e, q + 1) and not first[q + 1 : z].any():
                starts[q + 1] = False
                if z < n and kind[z] == LETTER:  # the other letters begin anew
                    starts[z] = True
                break
    return np.flatnonzero(starts)


def same_pieces(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each kind, and each piece's kind: by a hash of the characters, then compared character by character."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.diff(np.append(starts, len(points)))
    within = np.arange(len(points)) - np.repeat(starts, sizes)
    powers = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = np.add.reduceat((mixed ^ (mixed >> np.uint64(31))) * powers[within], starts)
    _, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    like = sample[inverse]
    if (sizes[like] != sizes).any() or (points[np.repeat(starts[like], sizes) + within] != points).any():
        seen: dict[str, int] = {}  # two pieces share a hash: compare the pieces themselves
        ends = starts + sizes
        inverse = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        sample = np.unique(inverse, return_index=True)[1]
    return sample, inverse


def supported(file: dict) -> dict:
    """The file's content, if it is byte-level BPE with the usual pattern and nothing else; any other step is an error."""
    model, before = file.get("model") or {}, file.get("pre_tokenizer") or {}
    wrong = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or wrong:
        raise ValueError(f"not a plain BPE model: {model.get('type')} {' '.join(wrong)}")
    if file.get("normalizer") is not None:
        raise ValueError("tokenizers with a normalizer are not supported")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the pre-tokenizer must be ByteLevel with its own pattern and without a prefix space")
    return file


class BytePairs:
    """Merges pieces of text; made once per worker from the tokenizer file's content."""

    def __init__(self, content: bytes):
        model = supported(json.loads(content))["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the file writes bytes as printable characters: printable bytes as themselves, others from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in set(plain)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.of_byte = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        last = {t: rank for rank, t in enumerate(self.made.tolist())}
        #: does every merge rank above those that make its parts?
        self.ordered = all(last.get(vocab[x], -1) < rank for rank, pair in enumerate(merges) for x in pair)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.ranks = np.zeros((1 << self.bits) + 64, dtype=np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at += 1
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.lengths = np.zeros(1024, dtype=np.int64)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.int32)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where they don't merge."""
        keys = left << 20 | right
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] += 1
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def merge(self, data: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(data)
        sizes = np.array([len(x) for x in data], dtype=np.int64)
        classes = np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        alone = (sizes >= LONG) & self.ordered
        for i in np.flatnonzero(alone):
            out[i] = self._merge_long(data[i])
        for k in np.unique(classes[~alone]):
            at = np.flatnonzero((classes == k) & (sizes > 0) & ~alone)
            step = max(1, (1 << 21) >> int(k))
            for s in range(0, len(at), step):
                self._merge_class([data[i] for i in at[s : s + step]], at[s : s + step], int(k), out)
        return out

    def _merge_class(self, data: list[bytes], places: np.ndarray, k: int, out: list[np.ndarray]) -> None:
        """Pieces of at most 2**k bytes, all trees in one array; a row that is done leaves it."""
        n, w = 1 << k, len(data)
        size = np.fromiter(map(len, data), dtype=np.int64, count=w)
        raw = np.frombuffer(b"".join(x.ljust(n, b"\0") for x in data), dtype=np.uint8).reshape(w, n)
        ids = self.of_byte[raw]
        column = np.arange(n)
        live = column < size[:, None]
        pair = column < size[:, None] - 1
        # the live neighbours; n and -1 are outside
        after = np.where(pair, column + 1, n)
        before = np.broadcast_to(column - 1, (w, n)).copy()
        tree = np.full((w, 2 * n), NONE)
        r = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(w, n - 1)
        tree[:, n : 2 * n - 1] = np.where((r >= 0) & pair[:, :-1], r * n + column[:-1], NONE)
        for level in range(k - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = tree[:, 2 * a : 4 * a].reshape(w, a, 2).min(axis=2)
        rows = np.flatnonzero(tree[:, 1] < NONE)
        flat_tree, flat_ids, flat_after, flat_before, flat_live = tree.ravel(), ids.ravel(), after.ravel(), before.ravel(), live.ravel()
        while len(rows):
            base, root = rows * n, rows * 2 * n
            best = flat_tree[root + 1]
            pos = best & (n - 1)
            rank = best >> k
            gone = flat_after[base + pos]
            nxt = flat_after[base + gone]
            prv = flat_before[base + pos]
            flat_ids[base + pos] = made = self.made[rank]
            flat_after[base + pos] = nxt
            flat_live[base + gone] = False
            right, left = nxt < n, prv >= 0
            flat_before[(base + nxt)[right]] = pos[right]
            flat_tree[root + n + gone] = NONE
            value = np.full(len(rows), NONE)
            if right.any():
                r = self.rank(made[right], flat_ids[(base + nxt)[right]])
                value[right] = np.where(r >= 0, r * n + pos[right], NONE)
            flat_tree[root + n + pos] = value
            at = [(root, n + gone), (root, n + pos)]
            if left.any():
                r = self.rank(flat_ids[(base + prv)[left]], made[left])
                flat_tree[(root + n + prv)[left]] = np.where(r >= 0, r * n + prv[left], NONE)
                at.append((root[left], n + prv[left]))
            for _ in range(k):  # the changed leaves' ancestors, level by level
                at = [(b, x >> 1) for b, x in at]
                for b, x in at:
                    flat_tree[b + x] = np.minimum(flat_tree[b + 2 * x], flat_tree[b + 2 * x + 1])
            rows = rows[flat_tree[root + 1] < NONE]
        counts = live.sum(axis=1)
        values = ids[live].astype(np.int32)
        for place, part in zip(places, np.split(values, np.cumsum(counts)[:-1]), strict=True):
            out[place] = part

    def _merge_long(self, data: bytes) -> np.ndarray:
        """One piece: each round merges all pairs of the least rank, the left one first where they overlap."""
        size = len(data)
        k = max(1, (size - 1).bit_length())
        n = 1 << k
        ids = self.of_byte[np.frombuffer(data, dtype=np.uint8)].astype(np.int32)
        after = np.arange(1, size + 1, dtype=np.int32)  # ``size`` and -1 are outside
        before = np.arange(-1, size, dtype=np.int32)
        live = np.ones(size, dtype=bool)
        tree = np.full(2 * n, NONE)

        def leaves(at: np.ndarray) -> np.ndarray:
            out = np.full(len(at), NONE)
            inner = np.flatnonzero(after[at] < size)
            r = self.rank(ids[at[inner]].astype(np.int64), ids[after[at[inner]]].astype(np.int64))
            out[inner] = np.where(r >= 0, r << k | at[inner], NONE)
            return out

        tree[n : n + size] = leaves(np.arange(size))
        for level in range(k - 1, -1, -1):
            a = 1 << level
            tree[a : 2 * a] = tree[2 * a : 4 * a].reshape(a, 2).min(axis=1)
        while tree[1] < NONE:
            rank = int(tree[1]) >> k
            at = np.ones(1, dtype=np.int64)
            for _ in range(k):  # all leaves of that rank, from left to right
                at = (at[:, None] * 2 + np.arange(2)).ravel()
                at = at[tree[at] >> k == rank]
            pos = at - n
            if len(pos) > 1:  # runs of pairs that share a token: every other one
                chained = np.append(False, after[pos[:-1]] == pos[1:])
                if chained.any():
                    first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
                    pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            gone = after[pos]
            behind = after[gone]
            ids[pos] = self.made[rank]
            after[pos] = behind
            live[gone] = False
            inner = behind < size
            before[behind[inner]] = pos[inner]
            left = before[pos]
            changed = np.unique(np.concatenate([pos, left[left >= 0]]))
            tree[n + gone] = NONE
            tree[n + changed] = leaves(changed)
            nodes = np.unique(np.concatenate([changed, gone])) + n
            for _ in range(k):
                nodes = nodes >> 1
                if len(nodes) > 1:
                    nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
        return ids[live]

    def _learn(self, words: list[str]) -> None:
        """Merge the new pieces and keep their ids; their codes were given in the order of the list."""
        merged = self.merge([x.encode() for x in words])
        first = len(self.codes) - len(words)
        while len(self.codes) > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        sizes = np.array([len(x) for x in merged], dtype=np.int64)
        flat = np.concatenate(merged) if merged else np.zeros(0, dtype=np.int32)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[first : len(self.codes)] = sizes
        self.starts[first : len(self.codes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the texts, and their ids one after the other; null and empty texts have none."""
        counts = np.zeros(len(texts), dtype=np.int64)
        parts: list[np.ndarray] = []
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= CHUNK):
                chars += len(texts[stop] or "")
                stop += 1
            counts[start:stop], ids = self._encode_chunk([x or "" for x in texts[start:stop]])
            parts.append(ids)
            start = stop
        return counts, np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int32)
        if len(self.codes) > REMEMBERED:
            self.forget()
        begins = np.cumsum([0, *map(len, texts)])
        starts = split_pieces(whole, begins[:-1])
        sample, inverse = same_pieces(whole, starts)
        cuts = np.append(starts, len(whole))
        pieces = [whole[a:b] for a, b in zip(starts[sample].tolist(), cuts[sample + 1].tolist(), strict=True)]
        codes = self.codes
        known = len(codes)
        code = np.array([codes.setdefault(x, len(codes)) for x in pieces], dtype=np.int64)[inverse]
        if len(codes) > known:
            self._learn(_tail(codes, len(codes) - known))
        lengths = self.lengths[code]
        ends = np.cumsum(lengths)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[code] - ends + lengths, lengths)]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, begins)]
        return np.diff(upto), ids


def _tail(d: dict, n: int) -> list:
    """The last n keys, in order."""
    it = reversed(d)
    return [next(it) for _ in range(n)][::-1]


_MADE: dict[str, BytePairs] = {}


def tokenizer(name: str, content) -> BytePairs:
    """The worker's tokenizer; content: a broadcast of the file's bytes, named by their digest."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = BytePairs(content.value)
    return _MADE[name]


def _shipped(df: DataFrame, path: str):
    """Digest and broadcast of the tokenizer file, which only the driver must have; a file of another kind is an error here."""
    with open(path, "rb") as f:
        content = f.read(MOST_FILE + 1)
    if len(content) > MOST_FILE:
        raise ValueError(f"a tokenizer file of more than {MOST_FILE} bytes")
    supported(json.loads(content))
    return hashlib.md5(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def _texts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for s in range(0, batch.num_rows, rows):
        part = batch.slice(s, rows)
        yield part, part.column(part.num_columns - 1).to_pylist()


def encode_texts(df: DataFrame, key: str, text: str, path: str = DEFAULT, ids: str = "ids") -> DataFrame:
    """``key`` and ``ids`` (array<int>, no special tokens) for every row; null and empty texts get an empty list.

    White space is text. The strings of special tokens are ordinary text. Repeated keys and null keys stay rows.
    """
    name, content = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                counts, flat = tokenizer(name, content).encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=["k", "i"])

    source = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    out = source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, i array<int>")
    return out.withColumnsRenamed({"k": key, "i": ids})


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str = DEFAULT, into: str = "tokens") -> DataFrame:
    """``keys`` and the number of tokens (bigint) of each row's text; 0 for null and empty texts."""
    name, content = _shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                counts, _ = tokenizer(name, content).encode(texts)
                yield pa.record_batch([*part.columns[:-1], pa.array(counts)], names=[*names, "n"])

    source = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").alias("t"))
    names = source.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, f"{schema}, n bigint")
    return out.withColumnsRenamed({**{f"k{i}": k for i, k in enumerate(keys)}, "n": into})
