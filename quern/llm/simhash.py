"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it set. Equal fingerprints are one class. The classes' representatives are
laid in tiles by the population counts of the parts of their first 64 bits: two
fingerprints within a radius differ by no more than that in the sum of these
counts, so only neighbouring tiles meet. What meets is compared by numpy, every
pair of it: exclusive-or and bit counts over blocks sorted by population count,
of which pairs of blocks that lie beyond the radius are skipped. So no link is
lost. A tile of more rows than ``TILE`` is cut into chunks that meet in tasks
of their own, and a task sends on a spanning forest of its links and not all of
them; components are the same.

The tiles' number is fixed by the counts, so on ever more different
fingerprints comparisons grow with the square of these, by a small share of it.

Null and empty texts have no shingles and the fingerprint 0, linked like any
other. Repeated rows are one class. Rows without an id get a component of the
ids linked to them, and null where there is none.

``deduplicate`` links texts by the similarity of their sets of shingles
instead: fingerprints of 128 bits, compared in the tiles of ``nearsets``,
propose, and the sets decide.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _io, nearsets
from quern.llm._text import mix
from quern.llm._tiles import forest, majority
from quern.llm.components import components

#: Fingerprints that a chunk of a tile holds, about: some 3 MB and four billion pairs, a quarter of a minute of a
#: core. A row is sent on once for each chunk that it meets, so smaller chunks cost shuffle and larger ones tasks.
TILE = 65_536
_BASE = 24


def fingerprint(text: str, width: int = 3, words: int = 1, seed: int = 42) -> tuple[list[int], int]:
    """(64-bit words of the fingerprint, number of shingles) of one text."""
    tokens = text.encode().lower().split()  # of bytes: only A-Z, and exactly U+0020 and U+0009 to U+000D
    n = len(tokens)
    if not n:
        return [0] * words, 0
    if n <= width:
        shingles = [b" ".join(tokens)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - width]])
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    return majority(hashes, words), len(shingles)


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and the fingerprint's words f0, f1, ... (signed 64-bit) of every document."""

    def one(batch: pa.RecordBatch) -> dict:
        rows = [fingerprint(x.as_py() or "", width, words) for x in batch.column("text")]
        prints = np.array([f for f, _ in rows], np.uint64).reshape(-1, words).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "n_shingles": pa.array([n for _, n in rows], pa.int64())} | {f"f{k}": prints[:, k] for k in range(words)}

    schema = "doc_id long, n_shingles long, " + ", ".join(f"f{k} long" for k in range(words))
    return _io.arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), one, schema)


class Tiles:
    """Where fingerprints meet: keys of tiles, their neighbours, and chunks of the full ones."""

    def __init__(self, radius: int):
        self.parts = 4 if radius <= 4 else 0
        near = [d for d in product(range(-radius, radius + 1), repeat=self.parts) if sum(map(abs, d)) <= radius] if self.parts else [()]
        deltas = {sum(x * _BASE**i for i, x in enumerate(d)) for d in near}
        #: Differences of keys to the neighbours that a tile visits; the others visit it.
        self.ahead = np.array(sorted(d for d in deltas if d > 0), np.int64)
        self.keys = self.chunks = np.zeros(0, np.int64)

    def key(self, first: np.ndarray) -> np.ndarray:
        key = np.full(len(first), 4 * _BASE**5, np.int64)
        for i in range(self.parts):
            key += (np.bitwise_count((first >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) + 3) * _BASE**i
        return key

    def chunk(self, keys: np.ndarray) -> np.ndarray:
        """Chunks of each tile, 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.chunks[at], 0)

    def places(self, key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, at home) of each block that a row goes to; own: the row's chunk.

        A block is a home chunk with all the single-chunk tiles that visit it,
        or with one chunk of a tile of several.
        """
        rows, block, home = [], [], []
        count = self.chunk(key)

        def add(row, home_key, home_chunk, slab_key, slab_chunk, at_home):
            rows.append(row)
            block.append(mix(mix(home_key.astype(np.uint64) + np.uint64(1)) + home_chunk.astype(np.uint64)) ^ mix(mix(slab_key.astype(np.uint64)) + slab_chunk.astype(np.uint64)))
            home.append(np.full(len(row), at_home))

        def spread(row, times):
            again = np.repeat(row, times)
            return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)

        zero = np.zeros(len(key), np.int64)
        every = np.arange(len(key))
        add(every, key, own, zero, zero, True)
        full = np.flatnonzero(count > 1)
        row, j = spread(full, count[full])
        later, sooner = j > own[row], j < own[row]
        add(row[later], key[row[later]], own[row[later]], key[row[later]], j[later], True)
        add(row[sooner], key[row[sooner]], j[sooner], key[row[sooner]], own[row[sooner]], False)
        for delta in self.ahead.tolist():
            there = self.chunk(key + delta)  # tiles that it visits
            row, i = spread(every, there)
            single = count[row] == 1
            add(row, key[row] + delta, i, np.where(single, 0, key[row]), np.where(single, 0, own[row]), False)
            there = self.chunk(key - delta)  # tiles that visit it in chunks of their own
            row, j = spread(every, np.where(there > 1, there, 0))
            add(row, key[row], own[row], key[row] - delta, j, True)
        return np.concatenate(rows), np.concatenate(block).view(np.int64), np.concatenate(home)


def links(classes: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """a, b: links whose components are those of all pairs of classes (id, f0, ...) within radius."""
    tiles = Tiles(radius)
    names = [f"f{k}" for k in range(words)]

    def lay(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "key": tiles.key(batch.column("f0").to_numpy().view(np.uint64))} | {n: batch.column(n) for n in names}

    kinds = ", ".join(f"{n} long" for n in names)
    laid = _io.arrow(classes.select("id", *names), lay, f"id long, key long, {kinds}")
    # tiles are few by construction: at most 17 to the power of the parts
    counts = laid.groupBy("key").count().orderBy("key").collect()
    tiles.keys = np.array([r["key"] for r in counts], np.int64)
    tiles.chunks = np.array([-(-r["count"] // TILE) for r in counts], np.int64)

    def deal(batch: pa.RecordBatch) -> dict:
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        own = (mix(ids.view(np.uint64)) % np.maximum(tiles.chunk(key), 1).astype(np.uint64)).astype(np.int64)
        row, block, home = tiles.places(key, own)
        taken = batch.take(pa.array(row))
        return {"block": block, "home": home, "id": taken.column("id")} | {n: taken.column(n) for n in names}

    def meet(part: pa.Table):
        home, ids = part.column("home").to_numpy(), part.column("id").to_numpy()
        prints = np.stack([part.column(n).to_numpy().view(np.uint64) for n in names], 1)
        for lo, hi in _io.runs(part.column("block").to_numpy()):
            if hi - lo > 1:
                root = forest(home[lo:hi], prints[lo:hi], radius)
                at = np.flatnonzero(root != np.arange(hi - lo))
                if len(at):
                    yield pa.RecordBatch.from_pydict({"a": ids[lo:hi][at], "b": ids[lo:hi][root[at]]})

    dealt = _io.arrow(laid, deal, f"block long, home boolean, id long, {kinds}")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda batches: _io.whole(batches, ["block"], meet), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the fingerprint's words, n_shingles and component_id (smallest linked doc_id, itself included)."""
    names = [f"f{k}" for k in range(words)]
    prints = _io.checkpoint(fingerprints(docs, width, words, doc_id, text))
    classes = _io.checkpoint(prints.groupBy(*names).agg(F.min("doc_id").alias("id")).where("id is not null"))
    # classes are joined by their fingerprints, so that ids that several of them share part none and join none
    classes = _io.checkpoint(classes.withColumn("doc_id", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
    found = components(links(classes, radius, words))
    named = classes.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select(*names, "doc_id", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select(*names, "component_id")
    return prints.join(named, names, "left").select("doc_id", *names, "n_shingles", "component_id")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (of the text), copies, component_id (smallest linked doc_id, itself included) and stays, of every different row.

    Rows link where the sets of their shingles are at least that similar; of
    the rows of a component that of the smallest id stays, of several of that
    id the one of the smallest mark. Rows without an id come last.
    """
    docs = nearsets.marked(docs, doc_id, text)
    sets = _io.checkpoint(nearsets.prefixes(docs, width, similarity, nearsets.frequent(docs, width)))
    classes, renumbered = nearsets.classes(sets)
    found = components(nearsets.candidates(sets, renumbered))
    _io.release(docs.sparkSession)
    verified = components(nearsets.links(docs, classes, found, width, similarity))
    named = classes.join(verified.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("first_row").alias("least"))
    named = named.join(least, "component").select(*nearsets.SET, "least")
    rows = sets.groupBy("doc_id", "mark", *nearsets.SET).agg(F.count("*").alias("copies")).join(named, nearsets.SET)
    return rows.select("doc_id", "mark", "copies", F.col("least.doc_id").alias("component_id"), (nearsets.row() == F.col("least")).alias("stays"))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that a chain of near copies links to one of smaller id; of rows of equal id and text one stays.

    Near copies are texts of at least that similarity of their sets of
    five-word shingles, compared exactly (see nearsets). What goes is a row, not
    an id: another text under the same id stays if it is like no other. A null
    text is an empty one.
    """
    found = _io.checkpoint(similar(docs, width, similarity, doc_id, text))
    source = _io.packed(docs).withColumns({"doc_id": F.col(f"_row.`{doc_id}`").cast("long"), "mark": nearsets.mark(F.col(f"_row.`{text}`"))})

    def are(rows: DataFrame, how: str, names: DataFrame) -> DataFrame:
        names = names.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        return rows.join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how)

    out = are(source, "left_anti", found.where("not stays"))
    again = found.where("stays and copies > 1")
    if not again.isEmpty():
        out = are(out, "left_anti", again).unionByName(are(out, "left_semi", again).dropDuplicates(["doc_id", "mark"]))
    return _io.unpacked(out)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(_io.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
