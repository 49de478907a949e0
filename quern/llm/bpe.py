"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash of the vocabulary: a pre-token that is a
vocabulary entry is one probe and one comparison of bytes. Tier two merges the
others with a heap of adjacent pairs over a doubly linked list of byte ranges,
lowest rank first and leftmost first among equals.

Nulls are empty texts and give no ids. Texts are encoded whole. Repeated rows are
encoded and returned each; an empty table gives an empty one. Columns of the new
columns' names are replaced, others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _io
from quern.llm._memo import Memo, chunk_text, chunks

#: Chunks and pre-tokens that each generation of a worker's memories holds (about 150 MB in all).
CHUNKS, PIECES = 300_000, 50_000
_MASK = (1 << 64) - 1


def _slot(h: int, seed: int, n: int) -> int:
    x = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace.

    Keys fall into as many buckets as there are keys. Largest first, each bucket
    of several keys gets the least seed that sends them all to free slots; a
    bucket of one key names its slot directly as -slot - 1.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        hashed = [xxhash.xxh64_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashed):
            buckets.setdefault(h % n, []).append(i)
        self.seeds, self.index = [0] * n, [-1] * n
        singles = []
        for bucket, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            seed = 1
            while True:
                at = [_slot(hashed[i], seed, n) for i in members]
                if len(set(at)) == len(at) and all(self.index[s] < 0 for s in at):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for s, i in zip(at, members, strict=True):
                self.index[s] = i
        free = (s for s in range(n) if self.index[s] < 0)
        for (bucket, i), s in zip(singles, list(free), strict=True):
            self.seeds[bucket], self.index[s] = -s - 1, i
        self.keys = [keys[i] for i in self.index]

    def find(self, key: bytes) -> int:
        """The key's place in the list it was built from, or -1."""
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % self.n]
        s = -seed - 1 if seed < 0 else _slot(h, seed, self.n)
        return self.index[s] if self.keys[s] == key else -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by successive merges of the pair of lowest rank, of these the leftmost.

    A node is a range of bytes; end has the byte after the node that begins at
    a place, which is where the next one begins, and 0 where none begins. An
    entry of the heap is one integer of rank, node and the pair's end.
    """
    n, rank = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    shift = n.bit_length()
    double, mask = 2 * shift, (1 << shift) - 1
    heap = [r << double | i << shift | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, stop = entry >> shift & mask, entry & mask
        right = end[i]
        if not right or right >= n or end[right] != stop:
            continue
        end[i], end[right] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, r << double | i << shift | end[stop])
        if (left := before[i]) >= 0 and (r := rank(piece[left:stop])) is not None:
            heapq.heappush(heap, r << double | left << shift | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes whole texts; ids are bytes of little-endian unsigned 32-bit integers.

    White space cuts a text into chunks whose pre-tokens don't depend on their
    neighbours; a worker remembers the ids of recent chunks and pre-tokens.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        tokens = list(self.ranks)
        self.hash, self.id_at = PerfectHash(tokens), [self.ranks[t] for t in tokens]
        self.token = {rank: t for t, rank in self.ranks.items()}
        # the library's \\s is the property White_Space, without U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        #: Only the known pattern is known to be cut safely at single spaces and newlines.
        self.cuts = pattern.endswith(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.pieces = Memo(self.lookup, PIECES)
        self.chunks = Memo(self.chunk, CHUNKS)

    def lookup(self, piece: str) -> bytes:
        raw = piece.encode()
        at = self.hash.find(raw)
        return self.id_at[at].to_bytes(4, "little") if at >= 0 else b"".join([i.to_bytes(4, "little") for i in merge(raw, self.ranks)])

    def chunk(self, chunk: str) -> bytes:
        text = chunk_text(chunk)
        if text and max(text) <= "\xff":  # letters after a space, alone or with one more mark, are one pre-token and the mark's
            word = text[text[0] == " " :]
            if word.isalpha():
                return self.lookup(text)
            if word[-1:] in ",.;:!?" and word[:-1].isalpha():
                return self.chunks[chunk[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.cuts and (parts := chunks(text)) is not None:
            return b"".join(map(self.chunks.__getitem__, parts))
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", round_trip: str | None = None) -> DataFrame:
    """docs with a column of ids as little-endian unsigned 32-bit integers (binary).

    round_trip: name of a column that says whether the ids decode to the text again.
    """
    return _coded(docs, path, pattern, text, ids, "encode", round_trip)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", raw: str = "decoded") -> DataFrame:
    """docs with a column of the ids' bytes; null ids decode to no bytes."""
    return _coded(docs, path, pattern, ids, raw, "decode")


def _coded(docs: DataFrame, path: str, pattern: str, source: str, target: str, verb: str, checked: str | None = None) -> DataFrame:
    def start():
        own = codec(path, pattern)
        code, empty = getattr(own, verb), "" if verb == "encode" else b""

        def run(column: pa.Array) -> dict:
            out = [code(x.as_py() or empty) for x in column]
            made = {target: pa.array(out, pa.binary())}
            if checked:
                made[checked] = pa.array([own.decode(i) == (x.as_py() or "").encode() for i, x in zip(out, column, strict=True)], pa.bool_())
            return made

        return run

    new = {target: "binary"} | ({checked: "boolean"} if checked else {})
    return _io.beside(docs, source, start, new, [*(c for c in docs.columns if c not in new), *new])


def op4_byte_bpe(spark, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the bytes decoded from them."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for x in batch.column("text"):
                ids = c.encode(x.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": decoded_sha})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
