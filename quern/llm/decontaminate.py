"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words (an item of
fewer words is one window). A window is a set of word shingles, each of up to
``shingle`` words. To be contained, a window needs all of its shingles, so by
the prefix principle its rarest one is a necessary prefix: a document without
it can't hold the window. Shingles are ordered by how often documents hold
them, counted over all documents in a first pass, then by hash. The second pass
joins documents' shingles with the windows' prefixes; positional and length
bounds drop candidates that would begin before or end after the document, and
the words themselves, as bytes, verify the rest.

Windows go to the workers in blocks of some ``MAX_BLOCK`` bytes of text, as
arrays of about ten times as many bytes; a benchmark of more is joined block
by block over all documents and the hits are merged, so nothing that grows is
broadcast whole. An item is in one block.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond
ASCII. Null and empty texts have no words; documents without hits are returned
too, and so is each of repeated rows. Benchmark rows of null text or id have no
windows; repeated ones count once. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _io
from quern.llm._text import ALNUM, LOWER, blocks, doc_of, equal, hashes, shingles, words

#: Bytes of benchmark text that workers hold the windows of at once.
MAX_BLOCK = 4 << 20


@dataclass
class Words:
    """The words of a block's items, joined by single spaces, and its windows before they are told apart."""

    data: np.ndarray
    starts: np.ndarray  # of words
    ends: np.ndarray
    hashed: np.ndarray  # of words
    at: np.ndarray  # first word of each window
    lengths: np.ndarray  # words of each window
    item: np.ndarray  # its place among names
    names: pa.Array


@dataclass
class Windows:
    """Windows of one block of items; equal windows of several items are one entry."""

    lengths: np.ndarray  # words of each window
    prefix: np.ndarray  # hash of each window's prefix, ascending
    offset: np.ndarray  # place of the prefix in its window
    width: np.ndarray  # words of the prefix shingle
    data: bytes
    first: np.ndarray  # where its words begin and end in data
    end: np.ndarray
    items: np.ndarray  # places among names, those of entry i from ranges[i] to ranges[i + 1]
    ranges: np.ndarray
    names: pa.Array
    sieve: np.ndarray  # by the low bits of a hash: may it be a prefix


def _read(names: pa.Array, texts: pa.Array, window: int) -> Words:
    parts, starts, ends, counts, base = [], [], [], [], 0
    for _, _, data, offsets in blocks(texts):
        data = LOWER[data]
        first, last, ranges = words(data, offsets, ALNUM)
        size = last - first
        begin = base + np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(begin - base, size) + where] = data[np.repeat(first, size) + where]
        parts.append(joined)
        starts.append(begin)
        ends.append(begin + size)
        counts.append(np.diff(ranges))
        base += len(joined)
    none = np.zeros(0, np.int64)
    data, starts, ends, counts = np.concatenate([np.zeros(0, np.uint8), *parts]), np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([none, *counts])
    many = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
    item = np.repeat(np.arange(len(counts)), many)
    at = np.repeat(np.cumsum(counts) - counts, many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    return Words(data, starts, ends, hashes(data, starts, ends), at, np.minimum(counts, window)[item], item, names)


def _keys(block: Words, shingle: int) -> tuple[np.ndarray, list[int]]:
    """(ascending hashes of all shingles of windows, their widths)."""
    widths = sorted(set(np.minimum(block.lengths, shingle).tolist()))
    found = [np.zeros(0, np.uint64)]
    for width in widths:
        every = shingles(block.hashed, width)
        own = np.minimum(block.lengths, shingle) == width
        used = np.zeros(len(block.hashed) + 1, np.int64)
        np.add.at(used, block.at[own], 1)
        np.add.at(used, block.at[own] + block.lengths[own] - width + 1, -1)
        found.append(every[np.flatnonzero(np.cumsum(used)[: len(every)])])
    return np.unique(np.concatenate(found)), widths


def _sieve(keys: np.ndarray) -> np.ndarray:
    bits = max(16, int(len(keys) * 8).bit_length())
    out = np.zeros(1 << bits, bool)
    out[(keys & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def _find(keys: np.ndarray, sieve: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, places of the first equal key) of hashes that are among ascending keys."""
    at = np.flatnonzero(sieve[(hashed & np.uint64(len(sieve) - 1)).astype(np.int64)])
    place = np.searchsorted(keys, hashed[at])
    ok = place < len(keys)
    ok[ok] = keys[place[ok]] == hashed[at][ok]
    return at[ok], place[ok]


def _arrange(block: Words, shingle: int, keys: np.ndarray, counts: np.ndarray) -> Windows:
    """Windows with their prefixes: of each the shingle that fewest documents hold, of these the least hash."""
    n = len(block.at)
    prefix, offset, whole = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for length in sorted(set(block.lengths.tolist())):
        rows, width = np.flatnonzero(block.lengths == length), min(shingle, length)
        every = shingles(block.hashed, width)
        held = counts[np.minimum(np.searchsorted(keys, every), len(keys) - 1)]
        best = block.at[rows]
        for j in range(1, length - width + 1):
            other = block.at[rows] + j
            better = (held[other] < held[best]) | ((held[other] == held[best]) & (every[other] < every[best]))
            best = np.where(better, other, best)
        prefix[rows], offset[rows], whole[rows] = every[best], best - block.at[rows], shingles(block.hashed, length)[block.at[rows]]
    first, end = block.starts[block.at], block.ends[block.at + block.lengths - 1]
    order = np.lexsort((block.item, whole, offset, block.lengths, prefix))
    i, j = order[:-1], order[1:]
    same = (whole[i] == whole[j]) & (prefix[i] == prefix[j]) & (offset[i] == offset[j]) & (block.lengths[i] == block.lengths[j])
    if not equal(block.data, first, end, i[same], j[same]):  # equal hashes of unequal windows: entries are then not shared
        same[:] = False
    new = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), ~same]))
    entry = order[new]
    small = lambda x: x.astype(np.int32)
    return Windows(small(block.lengths[entry]), prefix[entry], small(offset[entry]), small(np.minimum(block.lengths[entry], shingle)), block.data.tobytes(), first[entry], end[entry], small(block.item[order]), np.append(new, n), block.names, _sieve(prefix[entry]))


def _blocks(column):
    for lo, hi, data, offsets in blocks(column):
        data = LOWER[data]
        starts, ends, ranges = words(data, offsets, ALNUM)
        yield lo, hi, data, starts, ends, ranges, hashes(data, starts, ends)


def _counted(docs: DataFrame, keys: np.ndarray, widths: list[int]) -> DataFrame:
    """h, n: in how many documents each of the shingles keys lies."""
    sieve = _sieve(keys)

    def run(batches):
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, _, _, _, ranges, hashed in _blocks(batch.column("text")):
                own = doc_of(ranges)
                seen = []
                for width in widths:
                    at, place = _find(keys, sieve, shingles(hashed, width))
                    inside = own[at] == own[at + width - 1]
                    seen.append(own[at][inside] * len(keys) + place[inside])
                total += np.bincount(np.unique(np.concatenate(seen)) % len(keys), minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"h": keys[some].view(np.int64), "n": total[some]})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _hits(docs: DataFrame, block: Windows, text: str | None) -> DataFrame:
    """_row, row, n_words, spans (start, end of words, merged) and items of every document."""
    widths = sorted(set(block.width.tolist()))

    def one(batch: pa.RecordBatch) -> dict:
        counts, spans, items = [], [], []
        for lo, hi, data, starts, ends, ranges, hashed in _blocks(batch.column("text") if text is None else _io.field(batch, text)):
            own, raw = doc_of(ranges), None
            found: dict[int, tuple[list, set]] = {}
            for width in widths:
                at, place = _find(block.prefix, block.sieve, shingles(hashed, width))
                while len(at):
                    first = at - block.offset[place]
                    last = first + block.lengths[place] - 1
                    ok = (first >= ranges[own[at]]) & (last < ranges[own[at] + 1]) & (block.width[place] == width)
                    for f, l, p in zip(first[ok].tolist(), last[ok].tolist(), place[ok].tolist(), strict=True):
                        raw = data.tobytes() if raw is None else raw
                        if b" ".join([raw[starts[i] : ends[i]] for i in range(f, l + 1)]) == block.data[block.first[p] : block.end[p]]:
                            d = int(own[f])
                            spots, places = found.setdefault(d, ([], set()))
                            spots.append((f - int(ranges[d]), l + 1 - int(ranges[d])))
                            places.update(block.items[block.ranges[p] : block.ranges[p + 1]].tolist())
                    again = (place + 1 < len(block.prefix)) & (block.prefix[np.minimum(place + 1, len(block.prefix) - 1)] == block.prefix[place])
                    at, place = at[again], place[again] + 1
            counts += np.diff(ranges).tolist()
            spans += [merged(found[d][0]) if d in found else [] for d in range(hi - lo)]
            items += [sorted({block.names[i].as_py() for i in found[d][1]}) if d in found else [] for d in range(hi - lo)]
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return {"_row": batch.column("_row"), "row": batch.column("row"), "n_words": pa.array(counts, pa.int64()), "spans": pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], span), "items": pa.array(items, pa.list_(pa.string()))}

    return _io.arrow(docs, one, _io.carried(docs, "row long, n_words long, spans array<struct<first:long,end:long>>, items array<string>"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, max_block: int = MAX_BLOCK, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or their columns keep) as the struct column _row, n_words, spans of hit words and item ids of every document."""
    # without keep the text is read from the row and doesn't go to the workers twice
    kept = docs.columns if keep is None else keep
    source = _io.packed(docs) if keep is None else docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{text}`").cast("string").alias("text"))
    plain = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // max_block))
    if n > 1:
        source = source.withColumn("row", F.monotonically_increasing_id())
        source = _io.checkpoint(source)  # so that rows keep their numbers
    else:
        source = source.withColumn("row", F.lit(0).cast("long"))
    results = []
    for i in range(n):
        part = (items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i) if n > 1 else items).toArrow()
        block = _read(part.column("item").combine_chunks(), part.column("text").combine_chunks(), window)
        keys, widths = _keys(block, shingle)
        counts = np.zeros(max(len(keys), 1), np.int64)
        if len(keys):
            counted = _counted(plain, keys, widths).toArrow()  # no more rows than the block has shingles
            counts[np.searchsorted(keys, counted.column("h").to_numpy().view(np.uint64))] = counted.column("n").to_numpy()
        results.append(_hits(source, _arrange(block, shingle, keys, counts), None if keep is not None else text))
    if n == 1:
        return results[0].drop("row")
    whole = results[0]
    for other in results[1:]:
        whole = whole.unionByName(other)
    whole = whole.groupBy("row").agg(F.first("_row").alias("_row"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)"),
        lambda out, s: F.when((F.size(out) > 0) & (s["first"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(s["end"], F.element_at(out, -1)["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )
    # the last span is read only where there is one
    return whole.select("_row", "n_words", joined.alias("spans"), "items")


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs."""
    return _io.unpacked(overlaps(docs, benchmark, text=text, **options).where(F.size("spans") == 0))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, _io.table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select("_row.doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
