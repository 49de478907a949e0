"""Links of documents by the similarity of their sets of shingles: SimHash tiles propose, the sets decide.

The similarity of two texts is that of the sets of their distinct shingles
(runs of ``width`` words, a shorter text being one): common ones over all.
Equal sets are one class, of which one row stands for all.

Where classes meet: sets are put in one order for all documents, shingles that
are frequent in a sample last; two sets of a similarity of t then share a
shingle among the first  n - ceil(t n) + 1  of each. The classes that have a
shingle there are a tile, compared by exclusive-or and bit counts of 128-bit
fingerprints of their sets. At a similarity of 0.8 fingerprints differ in some
19 bits (deviation 4) and unlike ones in 64, so those within ``RADIUS`` are
candidates; a chain of candidates is a group. The sample decides the work only.

Each row of a group then goes once to a task of the group, or to one for each
chunk of a group of more than ``MEMBERS`` rows, with its whole set. There
fingerprints within the radius are compared by their sets, and what is similar
enough is linked; rows that links join already are not compared again, and a
task sends on a spanning forest. So work grows with the groups' sizes where
they hold together, and no row of it is a pair.

Shingles are compared by 64-bit hashes. Texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import _io, _memo, _text
from quern.llm._tiles import distance, forest, majority, near, unite

#: Documents of the sample by which frequent shingles are known, about, how many of them hold one, and shingles at most.
SAMPLE, FREQUENT, MOST = 20_000, 3, 1 << 18
#: Differing bits, of 128, up to which fingerprints are candidates: three deviations beyond those of a similarity of 0.8.
RADIUS = 32
#: Rows of a shingle that are compared at once; more meet chunk by chunk in tasks of their own.
TILE = 65_536
#: Rows that tiles are compared by together at least.
TABLE = 1 << 14
#: Rows of a group that a task compares by their sets: some 15 MB.
MEMBERS = 4096
#: Rows of a tile up to which it is compared together with others.
SMALL = 48
#: A set's size and two sums of its hashes, by which equal sets are known.
SET = ["n", "h1", "h2"]


def mark(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, mark and text of every row."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), mark(F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))


def row() -> Column:
    """A row as what rows are ordered by: those without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")


def sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Ascending hashes of the distinct shingles of each text."""
    for lo, hi, data, offsets in _text.blocks(column):
        data = _text.LOWER[data]
        starts, ends, ranges = _text.words(data, offsets, ~_text.ASCII_SPACE)
        hashed = _text.hashes(data, starts, ends)
        every = _text.shingles(hashed, width)
        for a, b in zip(ranges[: hi - lo], ranges[1:], strict=True):
            yield np.unique(every[a : b - width + 1]) if b - a >= width else _text.shingles(hashed[a:b], max(1, b - a))


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of several documents of a sample (columns doc_id, text), rarest first."""

    def one(batch: pa.RecordBatch) -> dict:
        found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets(batch.column("text"), width)]), return_counts=True)
        return {"s": found.view(np.int64), "n": n}

    share = SAMPLE / max(docs.count(), 1)
    sample = docs if share >= 1 else docs.where(F.rand(7) < share)  # of rows and not of ids, and in as many tasks as docs
    found = _io.checkpoint(_io.arrow(sample, one, "s long, n long").groupBy("s").agg(F.sum("n").alias("count")).where(F.col("count") >= FREQUENT))
    # the least count of which there aren't too many; no shingles are sorted for that
    total, least = 0, SAMPLE + 1
    for r in found.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.col("count").desc()).collect():  # no more rows than the sample has documents
        total += r["n"]
        if total > MOST:
            break
        least = r["count"]
    rows = found.where(F.col("count") >= least).toArrow()
    order = np.lexsort((rows.column("s").to_numpy(), rows.column("count").to_numpy()))
    return rows.column("s").to_numpy()[order].view(np.uint64)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64))


def prefixes(docs: DataFrame, width: int, least: float, late: np.ndarray) -> DataFrame:
    """doc_id, mark, the set (SET), its fingerprint and its first shingles."""
    places = np.argsort(late)
    known = late[places]

    def first(s: np.ndarray) -> np.ndarray:
        if len(s) and len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            s = s[np.argsort(np.where(known[at] == s, places[at] + 1, 0), kind="stable")]
        return s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]

    def one(batch: pa.RecordBatch) -> dict:
        _memo.forget()
        rows = [(len(s), s.sum(dtype=np.uint64), _text.mix(s + np.uint64(1)).sum(dtype=np.uint64), *majority(s, 2), first(s)) for s in sets(batch.column("text"), width)]
        n, h1, h2, f0, f1, heads = zip(*rows, strict=True) if rows else ((),) * 6
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n": np.array(n, np.int64), "h1": _signed(h1), "h2": _signed(h2), "f0": _signed(f0), "f1": _signed(f1), "first": _lists(list(heads))}

    return _io.arrow(docs, one, "doc_id long, mark string, n long, h1 long, h2 long, f0 long, f1 long, first array<long>")


def number(salt: int = 0) -> Column:
    return F.xxhash64(*SET, F.lit(salt))


def classes(sets_: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(SET, c, first_row of each class; those of them whose c isn't number(), if there are any).

    c is a class's number. Where several classes have one number, as happens
    to a few in 10**10, they get others, until no two are the same.
    """
    out, salt = _io.checkpoint(sets_.groupBy(*SET).agg(F.min(row()).alias("first_row")).withColumn("c", number())), 0
    while not (same := out.groupBy("c").count().where("count > 1").select(F.col("c").alias("_c"))).isEmpty():
        salt += 1
        out = _io.checkpoint(out.join(same, F.col("c") == F.col("_c"), "left").withColumn("c", F.when(F.col("_c").isNull(), F.col("c")).otherwise(number(salt))).drop("_c"))
    return out, out.where(F.col("c") != number()).select(*SET, "c") if salt else None


def _links(ids: np.ndarray, root: np.ndarray) -> dict:
    at = np.flatnonzero(root != np.arange(len(root)))
    return {"a": ids[at], "b": ids[root[at]]}


def candidates(sets_: DataFrame, renumbered: DataFrame | None = None) -> DataFrame:
    """a, b of classes whose fingerprints are near; only their components count."""
    schema = "a long, b long, token long, chunk int, f0 long, f1 long"

    def batch(part: dict, rest: dict | None = None) -> pa.RecordBatch:
        n = len(part["a"])
        rest = {k: pa.nulls(n, pa.int32() if k == "chunk" else pa.int64()) for k in ("token", "chunk", "f0", "f1")} if rest is None else rest
        return pa.RecordBatch.from_pydict({"a": pa.array(part["a"], pa.int64()), "b": part["b"] if isinstance(part["b"], pa.Array) else pa.array(part["b"], pa.int64())} | rest)

    def prints(part: pa.Table) -> np.ndarray:
        return np.stack([part.column(f).to_numpy().view(np.uint64) for f in ("f0", "f1")], 1)

    def meet(part: pa.Table):
        token, c, p = part.column("token").to_numpy(), part.column("c").to_numpy(), prints(part)
        ids, at = np.unique(c, return_inverse=True)
        root = np.arange(len(ids))  # one forest for all tiles of the table
        ranges = np.array(_io.runs(token))
        size = ranges[:, 1] - ranges[:, 0]
        rest = np.repeat(ranges[:, 1], size) - np.arange(len(token)) - 1  # rows after a row in its tile
        rest[np.repeat(size > SMALL, size)] = 0
        for d in range(1, SMALL):
            i = np.flatnonzero(rest >= d)
            if not len(i):
                break
            i = i[distance(p[i], p[i + d]) <= RADIUS]
            unite(root, at[i], at[i + d])
        for lo, hi in ranges[size > SMALL].tolist():
            own = forest(np.ones(hi - lo, bool), p[lo:hi], RADIUS)
            unite(root, at[lo:hi], at[lo:hi][own])
        yield batch(_links(ids, root))

    def run(batches):
        _memo.forget()
        chunks: dict[int, int] = {}

        def spill(part: pa.Table):
            """A chunk of a large tile: compared in itself, and sent on to meet the others."""
            yield from meet(part)
            token = part.column("token")[0].as_py()
            chunk = chunks[token] = chunks.get(token, -1) + 1
            yield batch({"a": part.column("c").to_numpy(), "b": pa.nulls(part.num_rows, pa.int64())}, {"token": part.column("token").combine_chunks(), "chunk": pa.array(np.full(part.num_rows, chunk), pa.int32()), "f0": part.column("f0").combine_chunks(), "f1": part.column("f1").combine_chunks()})

        return _io.whole(batches, ["token"], meet, least=TABLE, spill=spill, most=TILE)

    def across(batches):
        def links_(part: pa.Table):
            for lo, hi in _io.runs(*(part.column(k).to_numpy() for k in ("token", "left", "right"))):
                own = part.slice(lo, hi - lo).combine_chunks()
                home = own.column("chunk").to_numpy() == own.column("left").to_numpy()
                yield pa.RecordBatch.from_pydict(_links(own.column("a").to_numpy(), forest(home, prints(own), RADIUS)))

        return _io.whole(batches, ["token", "left", "right"], links_)

    own = sets_.groupBy(*SET).agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("first").alias("first"))
    own = own.withColumn("c", number()) if renumbered is None else own.join(renumbered, SET, "left").withColumn("c", F.coalesce("c", number()))
    laid = own.select(F.explode("first").alias("token"), "c", "f0", "f1")
    found = _io.checkpoint(laid.repartition("token").sortWithinPartitions("token").mapInArrow(run, schema))
    out, large = found.where("chunk is null").select("a", "b"), found.where("chunk is not null").drop("b")
    if not large.isEmpty():
        counts = large.groupBy("token").agg((F.max("chunk") + 1).alias("chunks"))
        dealt = large.join(counts, "token").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk")
        dealt = dealt.withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")}).drop("other", "chunks")
        keys = ["token", "left", "right"]
        out = out.unionByName(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(across, "a long, b long"))
    return out


def linked(left: np.ndarray, right: np.ndarray, prints: np.ndarray, values: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray:
    """Root of each row among the links of rows left with rows right whose sets are as similar as least.

    Sets are values[ends[i] : ends[i + 1]]. A row whose candidates aren't all
    joined to it yet is compared with all rows at once: its shingles are looked
    up in the rows' postings.
    """
    n = len(ends) - 1
    size = np.diff(ends)
    root = np.arange(n)
    pop = np.bitwise_count(prints).sum(1, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    postings, owner = values[order], np.repeat(np.arange(n), size)[order]
    done = np.zeros(n, bool)
    for i, j in near(left[np.argsort(pop[left], kind="stable")], right[np.argsort(pop[right], kind="stable")], prints, pop, RADIUS):
        open_ = root[i] != root[j]
        for x in dict.fromkeys(i[open_].tolist()):
            if done[x] or not (root[j[i == x]] != root[x]).any():
                continue
            done[x] = True  # compared with all rows, those of other tiles too
            own = values[ends[x] : ends[x + 1]]
            lo, hi = np.searchsorted(postings, own, "left"), np.searchsorted(postings, own, "right")
            many = hi - lo
            common = np.bincount(owner[np.arange(int(many.sum())) + np.repeat(lo - np.cumsum(many) + many, many)], minlength=n)
            alike = np.flatnonzero((common >= least * (size + size[x] - common) - 1e-9) & (distance(prints, prints[x]) <= RADIUS))
            unite(root, np.full(len(alike), x), alike)
    return root


def links(docs: DataFrame, classes_: DataFrame, groups: DataFrame, width: int, least: float) -> DataFrame:
    """a, b: links whose components are those of all pairs of one group (id, component) whose sets are as similar as least.

    docs: doc_id, mark, text.
    """
    spark = docs.sparkSession
    members = classes_.join(groups.withColumnRenamed("id", "c"), "c").select("c", "component", "first_row.doc_id", "first_row.mark")
    large = groups.groupBy("component").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks")).where("chunks > 1")
    placed = members.join(large, "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.select("c", "component", "chunks", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    texts = docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("component", "c", "chunks", "text")

    def one(batch: pa.RecordBatch) -> dict:
        _memo.forget()
        own = list(sets(batch.column("text"), width))
        prints = [majority(s, 2) for s in own]
        return {k: batch.column(k) for k in ("component", "c", "chunks")} | {"f0": _signed([f for f, _ in prints]), "f1": _signed([f for _, f in prints]), "s": _lists(own)}

    def meet(part: pa.Table):
        for lo, hi in _io.runs(*(part.column(k).to_numpy() for k in ("component", "left", "right"))):
            own = part.slice(lo, hi - lo).combine_chunks()
            ids, at = np.unique(own.column("c").to_numpy(), return_index=True)  # a row may stand twice in docs
            own = own.take(pa.array(at)).combine_chunks()
            chunk, a, b = (own.column(k).to_numpy() for k in ("chunk", "left", "right"))
            column = own.column("s").combine_chunks()
            ends = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]]
            prints = np.stack([own.column(f).to_numpy().view(np.uint64) for f in ("f0", "f1")], 1)
            yield pa.RecordBatch.from_pydict(_links(ids, linked(np.flatnonzero(chunk == a), np.flatnonzero(chunk == b), prints, values, ends - ends[0], least)))

    _io.small_batches(spark)
    laid = _io.arrow(texts, one, "component long, c long, chunks int, f0 long, f1 long, s array<long>")
    laid = laid.withColumn("chunk", F.pmod(F.xxhash64("c", F.lit(1)), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    laid = laid.select("component", "c", "f0", "f1", "s", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"))
    keys = ["component", "left", "right"]
    return laid.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _io.whole(batches, keys, meet), "a long, b long")
