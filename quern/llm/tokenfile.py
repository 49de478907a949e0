"""Token ids as flat binary files.

A dataset is a folder of parts ``NNNNN.bin``, unsigned little-endian integers
of 2 or 4 bytes one after another, and ``NNNNN.idx``, unsigned 64-bit pairs of
document id and end offset within the part. Parts ascend by document id; the
bases of their offsets are prefix sums of the parts' lengths, one number a
part. Parts are cut by bytes of text: these are summed up in the order of the
ids, first within ranges of them and then over the ranges, so that neither long
documents in a row nor one id of very many rows make a large part. There are at
most ``MAX_PARTS``, so what the driver gets and the workers are sent is bounded;
parts are larger instead, and are written as a stream.

Files are written under another name and renamed, so that a task run twice
leaves the same whole file, and read by memory maps. The folder lies in the
shared folder of the session and must be one that workers can open as a path,
or by pyarrow's file systems (then ranges are read instead of mapped).

Nulls and empty texts give only the end id. Rows without an id come first; rows
of equal ids are kept, in the order of the hashes of their texts, and so are
repeated rows. An empty table gives no parts.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _io
from quern.llm._memo import Memo

#: Bytes of text that a part is planned to hold, and parts at most.
PART_BYTES, MAX_PARTS = 32 << 20, 1 << 16
#: Chunks and pre-tokens that each generation of a worker's memories holds (about 170 MB in all).
CHUNKS, PIECES = 400_000, 50_000


class WordEncoder:
    """Ids of whole texts by the library, pre-token by pre-token.

    The tokenizer drops white space and never joins characters across it or
    across the edges of its own split, so a text's ids are those of its
    pre-tokens in turn; chunks between spaces and pre-tokens seen lately are
    remembered. A chunk that may hold a special string, or whose normal form
    isn't stable, goes to the library as it is; so does every whole text of a
    tokenizer without such a split.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.split, self.bpe = self.rule(path), self.model.model
        self.normal = self.model.normalizer.normalize_str if self.split else None
        self.pieces, self.chunks = Memo(self.piece, PIECES), Memo(self.chunk, CHUNKS)
        # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        self.byte_level = dict(zip([b for b in range(256) if b not in shown], range(0x100, 0x200), strict=False))

    @staticmethod
    def rule(path: str):
        """The split of a tokenizer that lower-cases, drops white space and is otherwise as chunk() takes it to be."""
        with open(path) as f:
            spec = json.load(f)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if normal != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"] or parts[1]["add_prefix_space"] or parts[0]["behavior"] != "Removed" or not parts[0]["invert"] or spec.get("post_processor") or not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            return None
        return regex.compile(parts[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall

    def one(self, text: str) -> bytes:
        return self.packed(self.model.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token by the library's model alone, without its steps before that."""
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.byte_level)
        return self.packed([t.id for t in self.bpe.tokenize(shown)])

    def chunk(self, chunk: str) -> bytes:
        if "<|" in chunk:
            return self.one(chunk)
        if chunk.isascii() or max(chunk) <= "\xff":  # characters that have one form, and a lower-case one
            normal = chunk.lower()
        elif self.normal(normal := self.normal(chunk)) != normal:
            return self.one(chunk)
        # letters alone, or with one more character after them, need no pattern
        if normal.isascii():
            if normal.isalpha():
                return self.piece(normal) if normal == chunk else self.chunks[normal]
            if normal[-1:] in ",.;:!?)" and normal[:-1].isalpha():
                return self.chunks[normal[:-1]] + self.pieces[normal[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(normal)))

    def encode(self, text: str) -> bytes:
        if not self.split:
            return self.one(text)
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(uri: str, mode: str):
    import pyarrow.fs as fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        return system, path
    return system.open_input_file(path).read_buffer()


class Writer:
    """A file that is there whole or not at all: written under a name of its own, then renamed."""

    def __init__(self, folder: str, name: str):
        own = f".{name}.{os.urandom(8).hex()}"
        self.system = None
        if folder.startswith("file:") or "://" not in folder:
            folder = folder.removeprefix("file://")
            os.makedirs(folder, exist_ok=True)
            self.own, self.name = f"{folder}/{own}", f"{folder}/{name}"
            self.file = open(self.own, "wb")  # noqa: SIM115
        else:
            self.system, path = _open(folder, "w")
            self.system.create_dir(path, recursive=True)
            self.own, self.name = f"{path}/{own}", f"{path}/{name}"
            self.file = self.system.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        if self.system:
            self.file.close()
            self.system.move(self.own, self.name)
        else:
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            os.replace(self.own, self.name)


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file of integers as a memory map, or its bytes where the folder is no path."""
    if folder.startswith("file:") or "://" not in folder:
        path = f"{folder.removeprefix('file://')}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    return np.frombuffer(_open(f"{folder}/{name}", "r"), dtype)


Key = tuple[bool, int, int]


def _key(doc_id: int | None, tie: int) -> Key:
    return doc_id is not None, doc_id or 0, tie


def cuts(docs: DataFrame) -> list[Key]:
    """First rows of the parts after the first, of docs (doc_id, tie, text)."""
    sized = docs.select("doc_id", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"))
    ranges = _io.checkpoint(sized.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie"))

    def total(batches):
        n = sum(int(b.column("size").to_numpy().sum()) for b in batches)
        yield pa.RecordBatch.from_pydict({"range": pa.array([TaskContext.get().partitionId()], pa.int32()), "size": pa.array([n], pa.int64())})

    sums = {r["range"]: r["size"] for r in ranges.mapInArrow(total, "range int, size long").collect()}  # a row a partition
    part = max(PART_BYTES, -(-sum(sums.values()) // MAX_PARTS))
    base, bases = 0, {}
    for k in sorted(sums):
        bases[k], base = base, base + sums[k]

    def firsts(batches):
        at = bases[TaskContext.get().partitionId()]
        for batch in batches:
            size = batch.column("size").to_numpy()
            begin = at + np.cumsum(size) - size
            # a row within which a multiple of a part's bytes lies begins a part
            new = np.flatnonzero((begin > 0) & ((begin + size - 1) // part != (begin - 1) // part))
            yield batch.take(pa.array(new)).select(["doc_id", "tie"])
            at += int(size.sum())

    rows = ranges.mapInArrow(firsts, "doc_id long, tie long").collect()  # less than a row a part
    return sorted(_key(r["doc_id"], r["tie"]) for r in rows)


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, int, int]]:
    """Encodes docs into folder; gives (part, base, ids) of each part in ascending order.

    Cuts between parts are found without the texts, which cross the network once, as ids.
    """
    value = F.col(f"`{text}`").cast("string")
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(value, F.lit(""))).alias("tie"), value.alias("text"))
    known = cuts(docs)
    width = encoder(path).width

    def encode(batches):
        e, turn = encoder(path), TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            ids, part = [e.encode(x.as_py() or "") + tail for x in batch.column("text")], []
            for d, tie in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True):
                low, high = bisect.bisect_left(known, _key(d, tie)), bisect.bisect_right(known, _key(d, tie))
                if high - low > 1:  # a row of which there are several parts: any of them will do
                    turn += 1
                    high = low + turn % (high - low + 1)
                part.append(high)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "ids": pa.array(ids, pa.binary())})

    def store(batches):
        part, out, docs_, ends, at = None, None, [], [], 0

        def close():
            out.close()
            index = Writer(folder, f"{part:05d}.idx")
            index.write(np.array([docs_, ends], "<i8").T.tobytes())
            index.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_ids": pa.array([at], pa.int64())})

        for batch in batches:
            for p, d, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if p != part:
                    if part is not None:
                        yield close()
                    part, out, docs_, ends, at = p, Writer(folder, f"{p:05d}.bin"), [], [], 0
                raw = ids.as_py()
                at += len(raw) // width
                out.write(raw)
                docs_.append(d if d is not None else -(1 << 63))
                ends.append(at)
        if part is not None:
            yield close()

    _io.small_batches(docs.sparkSession)
    encoded = docs.mapInArrow(encode, "part int, doc_id long, tie long, ids binary")
    spread = encoded.repartitionById(len(known) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "tie", "ids")
    rows = sorted({tuple(r) for r in spread.mapInArrow(store, "part int, n_ids long").collect()})  # a row a part
    base, out = 0, []
    for part, n in rows:
        out.append((part, base, n))
        base += n
    return out


def read(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]], width: int, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (or their crc32 as 32-bit integers) of each document, from the files."""
    kind = "ids_crc32 long" if digest else "token_ids array<long>"

    def run(batches):
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, index = mapped(folder, f"{part:05d}.bin", f"<u{width}"), mapped(folder, f"{part:05d}.idx", "<i8").reshape(-1, 2)
                starts = np.concatenate([[0], index[:-1, 1]])
                for lo in range(0, len(index), 4096):
                    own = [(ids[a:b]) for a, b in zip(starts[lo : lo + 4096], index[lo : lo + 4096, 1], strict=True)]
                    columns = {"doc_id": pa.array([None if x == -(1 << 63) else x for x in index[lo : lo + 4096, 0].tolist()], pa.int64()), "start": base + starts[lo : lo + 4096], "n_tokens": pa.array([len(x) for x in own], pa.int64())}
                    columns[kind.split()[0]] = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()) if digest else pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    table = spark.createDataFrame([(p, b) for p, b, _ in parts], "part int, base long").repartitionById(max(1, len(parts)), F.col("part"))
    return table.mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def op8_token_files(spark, sf_dir: str, path: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids as files and returns what the files hold."""
    import public_tokenizers

    path, folder = path or public_tokenizers.path("word_bpe_49k.json"), folder or _io.own_folder(spark, "tokens")
    parts = write(_io.table(spark, sf_dir, "documents"), path, folder, end_id)
    return read(spark, folder, parts, encoder(path).width, digest=True)
