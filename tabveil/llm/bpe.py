"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

The tree's leaf i holds (rank, i) of the pair that begins at token i, an inner node the smaller of its children, so
the root is the leftmost pair of lowest rank. A merge changes three leaves; each change climbs one path to the root.
Pieces of one size class are merged together, one merge of each piece at a time, so a step is a few numpy calls for
thousands of trees; a few long pieces take the same steps one after the other.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabveil.llm.bytesarrays import flat
from tabveil.session import ship

#: A file of public tokenizers, by name.
TOKENIZER = "byte_bpe_50k.json"
#: Fixed pattern of this family of byte-level tokenizers, with Unicode's own list of white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(1) << np.int64(62)
POS_BITS = 24
#: Pieces, and runs of them, that are remembered, and the longest of either: at most some 100 MB a worker.
CACHE_PIECES, CACHE_LENGTH = 300_000, 64
CELLS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary: itself where it can be printed, else from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        before = spec["pre_tokenizer"] or {}
        as_known = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if spec["model"].get("type", "BPE") != "BPE" or spec["normalizer"] or not as_known or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
            raise ValueError("not a byte-level BPE tokenizer with the usual pattern, no normalizer and no added space")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.text_of = [str(i) for i in range(size)]
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = {int(k): (n, int(m)) for n, (k, m) in enumerate(zip(keys, made, strict=True))}
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.slot = np.full(1 << 20, -1, dtype=np.int32)
        self.slot[self._slots(self.keys)] = np.arange(len(keys), dtype=np.int32)
        self.crowded = np.zeros(1 << 20, dtype=bool)
        n = np.bincount(self._slots(self.keys), minlength=1 << 20)
        self.crowded[n > 1] = True
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.spaces = regex.compile(r" (?:\p{White_Space}|$)")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str | int, tuple[int, ...]] = {}

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, at) of each pair of tokens in one number; NONE if the pair isn't mergeable or either is -1."""
        key = np.where((left < 0) | (right < 0), -1, (left << 20) | right)
        s = self._slots(key)
        i = self.slot[s]
        crowd = np.flatnonzero(self.crowded[s])
        if len(crowd):
            i[crowd] = np.minimum(np.searchsorted(self.keys, key[crowd]), len(self.keys) - 1)
        hit = (i >= 0) & (self.keys[i] == key)
        return np.where(hit, (self.ranks[i] << POS_BITS) | at, NONE)

    def merge_many(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int) -> list[tuple[int, ...]]:
        """Tokens of pieces of at most `size` (a power of two) bytes of data."""
        n, rows, at = len(begin), np.arange(len(begin)), np.arange(size)
        real = at < length[:, None]
        token = np.where(real, self.first[data[np.where(real, begin[:, None] + at, 0)]], -1)
        after = np.where(at + 1 < length[:, None], at + 1, -1)
        before = np.broadcast_to(at - 1, (n, size)).copy()
        following = np.full_like(token, -1)
        following[:, :-1] = token[:, 1:]
        tree = np.full((n, 2 * size), NONE)
        tree[:, size:] = self.leaves(token.ravel(), following.ravel(), np.broadcast_to(at, (n, size)).ravel()).reshape(n, size)
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2

        def put(r, i, value):
            node = i + size
            tree[r, node] = value
            while size > 1 and node[0] > 1:  # all leaves lie equally deep
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = rows[tree[:, 1] < NONE]
        while len(live):
            root = tree[live, 1]
            i, rank = root & ((1 << POS_BITS) - 1), root >> POS_BITS
            j = after[live, i]
            new = self.made[rank]
            token[live, i], token[live, j] = new, -1
            k = after[live, j]
            after[live, i] = k
            some = k >= 0
            before[live[some], k[some]] = i[some]
            put(live, j, np.full(len(live), NONE))
            put(live, i, self.leaves(new, np.where(some, token[live, k], -1), i))
            h = before[live, i]
            some = np.flatnonzero(h >= 0)
            if len(some):
                r, h = live[some], h[some]
                put(r, h, self.leaves(token[r, h], new[some], h))
            live = live[tree[live, 1] < NONE]
        keep = token >= 0
        flat_tokens, count = token[keep].tolist(), keep.sum(axis=1).cumsum().tolist()
        return [tuple(flat_tokens[a:b]) for a, b in zip([0, *count], count)]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same steps for one piece of any length; its tree takes 16 to 32 bytes a byte."""
        n, none, low = len(piece), 1 << 62, (1 << 40) - 1
        size = 1 << max(0, n - 1).bit_length()
        ids = self.first[np.frombuffer(piece, np.uint8)]
        start = self.leaves(ids, np.append(ids[1:], -1), np.zeros(n, np.int64))
        nodes = np.full(2 * size, none)
        nodes[size : size + n] = np.where(start == NONE, none, (start >> POS_BITS << 40) | np.arange(n))
        width = size
        while width > 1:
            nodes[width // 2 : width] = np.minimum(nodes[width : 2 * width : 2], nodes[width + 1 : 2 * width : 2])
            width //= 2
        tree, token = array("q", nodes.tobytes()), array("q", ids.tobytes())
        after, before = array("q", np.append(np.arange(1, n), -1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
        pairs = self.rank_of

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        def leaf(i: int) -> int:
            found = pairs.get((token[i] << 20) | token[after[i]]) if after[i] >= 0 else None
            return (found[0] << 40) | i if found else none

        while tree[1] < none:
            i, made = tree[1] & low, int(self.made[tree[1] >> 40])
            j = after[i]
            token[i], token[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return tuple(t for t in token if t >= 0)

    def learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of pieces."""
        out = {}
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        begin = np.cumsum(length) - length
        size = 1 << np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64)
        for s in np.unique(size).tolist():
            of = np.flatnonzero(size == s)
            if s > 4096 or len(of) < 8:
                for i in of.tolist():
                    out[pieces[i]] = self.merge_one(raw[i])
                continue
            step = max(1, CELLS // (2 * s))
            for lo in range(0, len(of), step):
                part = of[lo : lo + step]
                for i, ids in zip(part.tolist(), self.merge_many(data, begin[part], length[part], s), strict=True):
                    out[pieces[i]] = ids
        return out

    def parts(self, text: str) -> list[str | int]:
        """Special tokens as ids, and the text between them cut before single spaces where no piece goes across.

        A piece never goes from a character that isn't white space to a space, and a space before such a character is
        the head of the next piece; so texts without runs of white space fall apart into runs that recur often.
        """
        if self.split and any(s in text for s in self.special):
            return [x for n, p in enumerate(self.split.split(text)) for x in ([self.special[p]] if n % 2 else self.parts(p))]
        if "\0" in text or self.spaces.search(text):
            return [text] if text else []
        return text.replace(" ", "\0 ").split("\0") if text else []

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the strings of special tokens in it become those tokens."""
        if len(self.cache) > CACHE_PIECES or len(self.runs) > CACHE_PIECES:
            self.cache, self.runs = {}, {}
        found = [self.parts(t) for t in texts]
        new = {p for x in found for p in x}
        new.difference_update(self.runs)
        cut = [(p, self.pieces.findall(p)) for p in new if isinstance(p, str)]
        pieces = {w for _, x in cut for w in x}
        pieces.difference_update(self.cache)
        learned = self.learn(list(pieces))
        self.cache.update((w, ids) for w, ids in learned.items() if len(w) <= CACHE_LENGTH)
        long = {w: ids for w, ids in learned.items() if len(w) > CACHE_LENGTH}  # of these texts only
        get = (lambda w: long[w] if w in long else self.cache[w]) if long else self.cache.__getitem__
        once = {}
        for p, x in cut:
            into = self.runs if len(p) <= CACHE_LENGTH else once
            into[p] = get(x[0]) if len(x) == 1 else tuple(chain.from_iterable(map(get, x)))
        for p in new:
            if isinstance(p, int):
                self.runs[p] = (p,)
        of = (lambda p: once[p] if p in once else self.runs[p]) if once else self.runs.__getitem__
        for x in found:
            yield list(chain.from_iterable(map(of, x)))

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace").encode()


def tokenizer_file(path: str | None, name: str) -> str:
    """The text of a tokenizer's file, by its path or that of a public tokenizer: read on the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def text_groups(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows with at most about `limit` bytes of text."""
    _, at = flat(batch.column(batch.schema.get_field_index(column)))
    values, lo = batch.column(batch.schema.get_field_index(column)), 0
    while lo < batch.num_rows:
        hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1))
        yield lo, hi, [t or "" for t in values.slice(lo, hi - lo).to_pylist()]
        lo = hi


def encode_decode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", digests: bool = False, check: bool = False) -> DataFrame:
    """Encode each text, then decode its ids: id_column, ids array<int>, decoded; with digests n_tokens and SHA-256 instead.

    With check, same says whether the decoded text is the text, and takes its place.

    Null and empty texts have no ids and decode to the empty text. Rows with equal ids or texts stay rows of their own;
    other columns are not read. A map over partitions: no shuffle, and the cache of pieces is bounded.
    """
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path, TOKENIZER))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, same boolean" if check else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(spec.value)
        for batch in batches:
            for lo, hi, texts in text_groups(batch, text_column):
                a, b, c = [], [], []
                for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
                    decoded = bpe.decode(ids)
                    if digests:
                        a.append(len(ids))
                        b.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                        c.append(hashlib.sha256(decoded).hexdigest())
                    else:
                        a.append(ids)
                        b.append(decoded == text.encode() if check else decoded.decode())
                key = batch.column(batch.schema.get_field_index(id_column)).slice(lo, hi - lo)
                if digests:
                    yield pa.RecordBatch.from_arrays([key, pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([key, pa.array(a, pa.list_(pa.int32())), pa.array(b)], [id_column, "ids", "same" if check else "decoded"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)
