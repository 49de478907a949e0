"""Text and tables out of HTML, paginated text, documents and laid-out items."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The entities that are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, blocks end lines, entities are decoded and what then looks like a tag goes too."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/title)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"(?is)</?(script|style|iframe|object)\b[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\u00a0]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append([r for r in self.open.pop() if r])

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parse_tables(html: str | None) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of each table; the first row is the headers."""
    parser = _Tables()
    parser.feed(html or "")
    return [(t[0], t[1:]) for t in parser.tables if t]


def html_tables(pages: DataFrame, id_column: str, html: str) -> DataFrame:
    """id, table (from 0), headers, rows of each table of each page."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, h, r) for i, x in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist(), strict=True) for n, (h, r) in enumerate(parse_tables(x))]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_pydict({"id": pa.array([f[0] for f in found], batch.column("id").type), "table": pa.array([f[1] for f in found], pa.int32()), "headers": pa.array([f[2] for f in found], strings), "rows": pa.array([f[3] for f in found], pa.list_(strings))})

    return pages.select(F.col(id_column).alias("id"), F.col(html).alias("html")).mapInArrow(run, f"id {kind}, table int, headers array<string>, rows array<array<string>>")


def pages(text: Column) -> Column:
    """page, text of a text cut at lines ``Page_Number: N``; what comes before the first such line is page 0."""
    parts = F.split(text, r"(?m)^Page_Number: *\d+ *$\n?")
    numbers = F.regexp_extract_all(text, F.lit(r"(?m)^Page_Number: *(\d+) *$"), F.lit(1))
    cut = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, 0).otherwise(F.try_element_at(numbers, i).cast("int")).alias("page"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("text")))
    return F.filter(cut, lambda p: p["text"] != "")


def laid_out_lines(items: DataFrame, page: str = "page") -> DataFrame:
    """page, line, cells of text items (page, x, y, width, height, text): equal rounded y is a line, a gap of over 1.5 heights a new cell."""
    w = Window.partitionBy("doc", page, "_line").orderBy("x")
    lined = items.withColumn("_line", F.round(F.col("y")))
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    cut = lined.withColumn("_cell", F.sum(F.coalesce((gap > 1.5 * F.col("height")).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cut.groupBy("doc", page, "_line", "_cell").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("_t"))
    cells = cells.select("doc", page, "_line", "_cell", F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("cell"))
    return cells.groupBy("doc", page, F.col("_line").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "cell"))), lambda c: c["cell"]).alias("cells"))


def laid_out_tables(items: DataFrame) -> DataFrame:
    """doc, page, rows, columns, confidence of pages with at least two lines of the same several cells."""
    lines = laid_out_lines(items).withColumn("_n", F.size("cells")).where("_n > 1")
    shapes = lines.groupBy("doc", "page", "_n").agg(F.count("*").alias("_c"))
    best = shapes.groupBy("doc", "page").agg(F.max_by("_n", F.struct("_c", "_n")).alias("columns"), F.max("_c").alias("rows"), F.sum("_c").alias("_all"))
    return best.where("rows >= 2").select("doc", "page", "rows", "columns", (F.col("rows") / F.col("_all")).alias("confidence"))


# Documents of archives and XML, by media type

Extractor = Callable[[bytes], str]
_REGISTRY: dict[str, Extractor] = {}


def register(media: str) -> Callable[[Extractor], Extractor]:
    """Adds an extractor of bytes to text for a media type."""

    def add(function: Extractor) -> Extractor:
        _REGISTRY[media] = function
        return function

    return add


def _members(data: bytes, prefix: str, tag: str) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if n.startswith(prefix) and n.endswith((".xml", ".xhtml", ".html"))):
            root = ElementTree.fromstring(z.read(name))
            out += ["".join(e.itertext()) for e in root.iter() if e.tag.rpartition("}")[2] == tag]
    return "\n".join(x for x in out if x.strip())


@register("application/vnd.openxmlformats-officedocument.wordprocessingml.document")
def docx(data: bytes) -> str:
    return _members(data, "word/document", "p")


@register("application/vnd.openxmlformats-officedocument.presentationml.presentation")
def pptx(data: bytes) -> str:
    return _members(data, "ppt/slides/slide", "p")


@register("application/epub+zip")
def epub(data: bytes) -> str:
    return _members(data, "", "p")


@register("message/rfc822")
def eml(data: bytes) -> str:
    import email
    from email import policy

    message = email.message_from_bytes(data, policy=policy.default)
    body = message.get_body(("plain", "html"))
    return f"{message.get('subject', '')}\n{body.get_content() if body else ''}".strip()


@register("application/rtf")
def rtf(data: bytes) -> str:
    import re

    text = re.sub(r"\\par[d]?\b ?", "\n", data.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("latin-1"), text)
    return re.sub(r"\{\\\*[^{}]*\}|\\[a-zA-Z]+-?\d* ?|[{}]", "", text).strip()


@register("text/plain")
def plain(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Rows of the first sheet that isn't empty, blank rows left out; the first row is the headers."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        for name in sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet")):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{space}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.iter(f"{space}c")):
                    letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                    at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters))) - 1 if letters else n
                    value = c.find(f"{space}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{space}t"))
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" and value is not None else inline or (value.text if value is not None else "") or ""
                if any(v.strip() for v in cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            if rows:
                return rows
    return []


@register("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
def xlsx(data: bytes) -> str:
    return "\n".join("\t".join(r) for r in xlsx_rows(data))


@register("text/html")
def html(data: bytes) -> str:
    import html as entities
    import re

    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", data.decode("utf-8", "replace"))
    return " ".join(entities.unescape(re.sub(r"(?s)<[^>]*>", " ", text)).split())


def extract(documents: DataFrame, media: str = "media_type", content: str = "content", id_column: str = "id") -> DataFrame:
    """id, text, error of documents by their media type; an unknown type or a broken file is an error and not a failure."""
    registry = dict(_REGISTRY)
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for m, c in zip(batch.column("m").to_pylist(), batch.column("c").to_pylist(), strict=True):
                text = error = None
                if m not in registry:
                    error = f"unsupported: {m}"
                else:
                    try:
                        text = registry[m](c or b"")
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        error = f"broken: {type(e).__name__}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    return documents.select(F.col(id_column).alias("id"), F.col(media).alias("m"), F.col(content).alias("c")).mapInArrow(run, f"id {kind}, text string, error string")
