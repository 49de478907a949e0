"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that come back as one
token are proven whole. A pre-token in that set counts one without any merging;
only the rest is merged, by the library itself, and remembered.

The piece model's pre-tokens are a run of word marks with what follows up to
the next mark or newline, or a newline with what follows. No vocabulary string
holds a mark after another character or a newline at all (checked when the
model is loaded), so no merge crosses a pre-token's edge and counts add up.
Where a model fails that check, whole texts are encoded.

Nulls and empty texts have no tokens. Texts are counted whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _io
from quern.llm._memo import Memo

MARK = "▁"
MEMO = 150_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*").findall


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces) and self.model.encode("a  b\nc ", out_type=str)[0].startswith(MARK)
        #: Words that follow a mark and are proven to be one token with it.
        self.whole = self.prove(pieces) if self.cuts else frozenset()
        self.words = Memo(self.merge, MEMO)

    def prove(self, pieces: list[str]) -> frozenset[str]:
        plain = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        return frozenset(w for w, ids in zip(plain, self.model.encode(plain), strict=True) if len(ids) == 1)

    def merge(self, word: str) -> int:
        """Tokens of a word after one mark, of a run of marks with its word, or of a newline with its word."""
        if word in self.whole:
            return 1
        if word[:1] == "\n":
            return len(self.model.encode(word)) - 1  # without the mark that the library puts first
        if word[:1] == MARK:
            return len(self.model.encode(" " * (len(word) - len(word.lstrip(MARK)) - 1) + word.lstrip(MARK))) if word.strip(MARK) else self.marks(len(word))
        return len(self.model.encode(word))

    def marks(self, n: int) -> int:
        return len(self.model.encode(" " * (n - 1))) if n > 1 else 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text))
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or MARK in text:
            parts = [p if p[0] == "\n" or p[:2] == MARK * 2 or p == MARK else p[1:] for p in _SEGMENT(MARK + text.replace(" ", MARK))]
        return sum(map(self.words.__getitem__, parts))


class JsonCounter:
    """The same for a tokenizers file, counting whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False)) if text else 0


@lru_cache(2)
def counter(path: str) -> PieceCounter | JsonCounter:
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens above limit) of every document."""

    def one(batch: pa.RecordBatch) -> dict:
        count = counter(path).count
        column = batch.column("text").fill_null("")
        n = [count(x.as_py()) for x in column]
        return {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(column).cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}

    return _io.arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), one, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return count_tokens(_io.table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model"))
