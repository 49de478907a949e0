"""Per-document text statistics, computed on blocks of bytes.

Words are maximal runs of bytes outside U+0020 and U+0009 to U+000D. Nulls are
empty texts, whose statistics are all 0. Words and lines are equal where their
bytes are (see _text.numbered); every text is read whole. Repeated rows get the
same statistics each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _io, _memo
from quern.llm._text import ASCII_SPACE, blocks, doc_of, numbered, per_doc, words

SYMBOLS = b"#*$%&|<>"
#: Names of the statistics, in the order of the columns of measure().
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_stops", "n_distinct_words", "n_shout_words")

_WORD = ~ASCII_SPACE


def _set(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _STOP = _set(SYMBOLS), _set(range(0x41, 0x5B)), _set(range(0x30, 0x3A)), _set(b".!?")
_LETTER = _UPPER | _set(range(0x61, 0x7B)) | _set(range(0x80, 0x100))
_MARK = _set([b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True


def ranked(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A number of each pair (key, more), the same for equal pairs only; both are below 2**31."""
    return np.unique((keys << 31) + more, return_inverse=True)[1]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there an equal key, is there an equal key before), for each key."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document of a block."""
    starts, ends, ranges = words(data, offsets, _WORD)
    own = doc_of(ranges)
    head = ~_CONTINUED[data]
    number = numbered(data, starts, ends)
    # a word of a document, and windows of three as pairs of pairs: equal numbers are equal words of one document
    in_doc = ranked(number, own)
    n = max(0, len(starts) - 2)
    inside = own[2:] == own[:n]
    twice = np.zeros(n, bool)
    twice[inside], _ = repeated(ranked(ranked(in_doc[:n][inside], number[1 : n + 1][inside]), number[2:][inside]))
    cover = np.zeros(len(starts), bool)
    for j in range(3):
        cover[j : j + n] |= twice
    _, word_again = repeated(in_doc)

    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 0x0A) + 1]))
    line_starts = line_starts[line_starts <= len(data)]
    # a line that begins where a document ends is that document's last, empty one and the next one's first alike
    line_ends = np.concatenate([line_starts[1:], [len(data)]]) if len(line_starts) else line_starts
    closed = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 0x0A) if len(data) else np.zeros(len(line_starts), bool)
    line_ends = line_ends - closed
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[worded], line_ends[worded], line_doc[worded]
    _, line_again = repeated(ranked(numbered(data, line_starts, line_ends), line_doc))
    line_at = np.searchsorted(line_doc, np.arange(len(offsets)))

    upper, letter = _UPPER[data], _LETTER[data]
    upper_sum, letter_sum = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, letter & head))
    uppers, letters = upper_sum[ends] - upper_sum[starts], letter_sum[ends] - letter_sum[starts]
    columns = {
        "n_words": np.diff(ranges),
        "word_chars": per_doc(_WORD[data] & head, offsets),
        "n_symbols": per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": per_doc(line_again, line_at),
        "n_repeat_words": per_doc(cover, ranges),
        "n_chars": per_doc(head, offsets),
        "n_lines": np.diff(line_at),
        "n_upper": per_doc(upper, offsets),
        "n_letters": per_doc(letter & head, offsets),
        "n_digits": per_doc(_DIGIT[data], offsets),
        "n_marks": per_doc(_MARK[data], offsets),
        "n_stops": per_doc(_STOP[data], offsets),
        "n_distinct_words": per_doc(~word_again, ranges),
        "n_shout_words": per_doc((uppers >= 2) & (uppers == letters), ranges),
    }
    return np.stack([columns[n] for n in NAMES], 1).astype(np.int64)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and NAMES of every document."""

    def one(batch: pa.RecordBatch) -> dict:
        column = batch.column("text")
        rows = [measure(data, offsets) for _, _, data, offsets in blocks(column)]
        values = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)), np.int64)
        return {"doc_id": batch.column("doc_id")} | {n: values[:, i] for i, n in enumerate(NAMES)}

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)
    return _io.arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), one, schema)


def attached(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as the struct column _row, and NAMES."""
    source = _io.packed(docs)

    def one(batch: pa.RecordBatch) -> dict:
        _memo.forget()
        rows = [measure(data, offsets) for _, _, data, offsets in blocks(_io.field(batch, text))]
        values = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)), np.int64)
        return {"_row": batch.column("_row")} | {n: values[:, i] for i, n in enumerate(NAMES)}

    return _io.arrow(source, one, _io.carried(source, ", ".join(f"{n} long" for n in NAMES)))
