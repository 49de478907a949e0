"""Lexical, vector and fused retrieval, and what follows it.

Queries are small tables (query, text or vector) that are joined with all
documents at once; per-query heads are window ranks over partial results, so
work spreads over the documents and never sits on one task per query.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.checkpoints import checkpoint
from quern.functions.scalar import STOP_WORDS, char_windows, has_token, words

K1, B = 1.2, 0.75
#: Distinct query terms up to which documents are scanned by one pattern instead of being cut into words.
MAX_PATTERN_TERMS = 256
RRF_K = 60


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case ASCII words without stop words, with light suffix stripping (ing, ed, es, s)."""

    def strip(w: Column) -> Column:
        out = F.when(w.endswith("ing") & (F.length(w) > 6), F.substring(w, F.lit(1), F.length(w) - 3))
        out = out.when(w.endswith("ed") & (F.length(w) > 5), F.substring(w, F.lit(1), F.length(w) - 2))
        out = out.when(w.endswith("es") & (F.length(w) > 5), F.substring(w, F.lit(1), F.length(w) - 2))
        return out.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    plain = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(list(stop_words)))
    return F.transform(plain, strip)


def postings(docs: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """id, term, tf, dl."""
    found = docs.select(F.col(id_column).alias("id"), terms(F.col(text)).alias("_t")).withColumn("dl", F.size("_t"))
    return found.select("id", "dl", F.explode("_t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def common_terms(posted: DataFrame, n: Column | int, share: float = 0.2) -> DataFrame:
    """Terms in at least a share of the documents."""
    n = F.lit(n) if isinstance(n, int) else n
    return posted.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= share * n)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_column: str = "id", text: str = "text", stop_share: float | None = None) -> DataFrame:
    """query, id, score, rank of the first k documents a query; scores over the query's best, ties by id.

    Corpus totals and document frequencies cover all documents; only postings of
    query terms are shuffled. stop_share drops terms in that share of documents.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    named = sorted({r["term"] for r in asked.select("term").distinct().limit(MAX_PATTERN_TERMS + 1).collect()})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # a document's length needs no stems
    length = F.size(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(list(STOP_WORDS))))
    if not named or len(named) > MAX_PATTERN_TERMS:
        found = terms(F.col(text))
    else:
        # a term is the start of all words that it stands for: only these are cut out and stemmed
        begun = F.regexp_extract_all(low, F.lit("(?<![a-z0-9])(?:" + "|".join(named) + ")[a-z0-9]*"), F.lit(0))
        found = F.filter(terms(F.array_join(begun, " ")), lambda t: t.isin(named))
    source = docs.select(F.col(id_column).alias("id"), length.alias("dl"), found.alias("_t"))
    if named and len(named) <= MAX_PATTERN_TERMS:
        source = checkpoint(source)  # texts are read once; what is kept of them is what the queries name
    totals = source.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hit = source.where(F.size("_t") > 0).select("id", "dl", F.explode("_t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    posted = hit.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    weighed = posted.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    if stop_share is not None:
        weighed = weighed.where(F.col("df") < stop_share * F.col("n"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weighed.withColumn("part", part).join(asked, "term").groupBy("query", "id").agg(F.sum("part").alias("raw"))
    return normalised(head(scored, k, score="raw"), "raw")


def normalised(df: DataFrame, raw: str) -> DataFrame:
    """score: raw over the query's largest; for heads, which hold it, so that no more than these rows are gathered."""
    best = F.max(raw).over(Window.partitionBy("query"))
    return df.withColumn("score", F.col(raw) / F.greatest(best, F.lit(1e-9))).drop(raw)


def head(df: DataFrame, k: int, key: str = "query", score: str = "score") -> DataFrame:
    """The first k rows of each key by descending score and id, ranked from 1."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def short_token_search(docs: DataFrame, tokens: Sequence[str], k: int, id_column: str = "id", text: str = "text") -> DataFrame:
    """id, score: documents that hold every token, by occurrences over the largest number of them."""
    count = sum((F.regexp_count(F.col(text), F.lit("\\Q" + t + "\\E")) for t in tokens), F.lit(0))
    hits = docs.select(F.col(id_column).alias("id"), F.col(text).alias("_x"), count.alias("n"))
    for t in tokens:
        hits = hits.where(F.col("_x").contains(t))
    best = F.broadcast(hits.agg(F.max("n").alias("_m")))
    return hits.crossJoin(best).select("id", (F.col("n") / F.col("_m")).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def keyword_rank(nodes: DataFrame, query_terms: Sequence[str], k: int, label: str = "label", content: str = "content", tags: str = "tags", updated: str = "updated_at", scan_cap: int | None = None) -> DataFrame:
    """Nodes in which every term occurs: 4 a term in the label, 2 in the content, 1 in the tags, 1 for the whole phrase.

    Without terms no node is found.
    """
    if not query_terms:
        return nodes.limit(0).withColumn("score", F.lit(0))
    rows = nodes if scan_cap is None else nodes.orderBy(F.col(updated).desc(), "id").limit(scan_cap)
    low = {c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (label, content)} | {tags: F.lower(F.array_join(F.coalesce(F.col(tags), F.array().cast("array<string>")), " "))}
    score: Column = F.lit(0)
    for t in query_terms:
        inside = {c: low[c].contains(t) for c in low}
        rows = rows.where(inside[label] | inside[content] | inside[tags])
        score = score + 4 * inside[label].cast("int") + 2 * inside[content].cast("int") + inside[tags].cast("int")
    if len(query_terms) > 1:
        phrase = " ".join(query_terms)
        score = score + (low[label].contains(phrase) | low[content].contains(phrase)).cast("int")
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), F.col(updated).desc(), "id").limit(k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "id", vector: str = "embedding", query_id: str = "query", exclude_self: bool = False, max_queries: int = 4096, min_score: float | None = None) -> DataFrame:
    """query, id, score, rank: exact cosine neighbours, of at least a score if one is given.

    Queries go to the workers in blocks of at most ``max_queries``, and each
    batch of vectors is one matrix product a block; a batch passes on its best k
    only. Vectors of no length score 0. Vectors of another length than the
    queries' are left out.
    """
    spark = vectors.sparkSession
    kind = queries.schema[query_id].dataType.simpleString()
    own = vectors.schema[id_column].dataType.simpleString()
    out = None
    rows = queries.select(query_id, F.col(vector).alias("_v")).where("_v is not null").orderBy(query_id)
    block: list = []

    def pass_over(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        matrix = np.array([r[1] for r in block], float)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        places = {q: i for i, q in enumerate(ids)}

        def run(batches):
            for batch in batches:
                names, values = batch.column("id"), batch.column("v")
                data = [(n, x) for n, x in zip(names.to_pylist(), values.to_pylist(), strict=True) if x is not None and len(x) == matrix.shape[1]]
                if not data:
                    continue
                m = np.array([x for _, x in data], float)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                scores = matrix @ np.divide(m, length, out=np.zeros_like(m), where=length > 0).T
                # rounded, so that equal scores tie in whatever batch they are computed
                scores = np.round(scores, 9)
                here = [n for n, _ in data]
                if exclude_self:
                    for j, n in enumerate(here):
                        if n in places:
                            scores[places[n], j] = -np.inf
                order = np.argsort(np.array(here), kind="stable")
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, : min(k, len(here))]]
                q = np.repeat(np.arange(len(ids)), best.shape[1])
                j = best.ravel()
                ok = np.isfinite(scores[q, j]) & (min_score is None or scores[q, j] >= min_score)
                yield pa.RecordBatch.from_pydict({"query": pa.array([ids[a] for a in q[ok]], type=_arrow(kind)), "id": pa.array([here[b] for b in j[ok]], type=_arrow(own)), "score": scores[q, j][ok]})

        return vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).mapInArrow(run, f"query {kind}, id {own}, score double")

    for row in rows.toLocalIterator():
        block.append((row[0], list(row[1])))
        if len(block) == max_queries:
            part, block = pass_over(block), []
            out = part if out is None else out.unionByName(part)
    if block:
        part = pass_over(block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query {kind}, id {own}, score double, rank int")
    return head(out, k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def rrf(lists: DataFrame, k: int = RRF_K, key: str = "query") -> DataFrame:
    """query, id, score, lists_matched: reciprocal ranks of (list, id, rank) summed, over the best; ties by id."""
    raw = lists.groupBy(key, "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("raw"), F.countDistinct("list").alias("lists_matched"))
    best = F.max("raw").over(Window.partitionBy(key))
    return raw.withColumn("score", F.col("raw") / best).drop("raw")


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    both = lexical.select("query", "id", "rank", F.lit("lexical").alias("list")).unionByName(semantic.select("query", "id", "rank", F.lit("semantic").alias("list")))
    return head(rrf(both), k)


def multi_query(seeds: DataFrame, parents: DataFrame | None, k: int) -> DataFrame:
    """Seeds (query, phrasing, leg, id, rank) fused over phrasings and legs; alias ids (id#qN) stand for their parents."""
    parent = F.regexp_replace(F.col("id").cast("string"), r"#[qp]\d+$", "")
    collapsed = seeds.withColumn("id", parent).groupBy("query", "phrasing", "leg", "id").agg(F.min("rank").alias("rank"))
    if parents is not None:
        collapsed = collapsed.join(parents.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    return head(rrf(collapsed.withColumn("list", F.concat_ws("/", "phrasing", "leg"))), k)


def pieces(docs: DataFrame, id_column: str = "id", title: str | None = None, text: str = "text", size: int = 480, overlap: int = 120) -> DataFrame:
    """id (doc#pN, from 1; #p0 is the title), parent, text of a document's windows."""
    windows = char_windows(F.col(text), size, overlap)
    if title:
        windows = F.concat(F.array(F.col(title)), windows)
    out = docs.select(F.col(id_column).alias("parent"), F.posexplode(windows).alias("_n", "text"))
    return out.select(F.concat(F.col("parent").cast("string"), F.lit("#p"), (F.col("_n") + (0 if title else 1)).cast("string")).alias("id"), "parent", "text")


def best_piece(hits: DataFrame, k: int) -> DataFrame:
    """A document scores as the best of its pieces: query, id, score, rank."""
    parent = F.regexp_replace(F.col("id").cast("string"), r"#[qp]\d+$", "")
    return head(hits.groupBy("query", parent.alias("id")).agg(F.max("score").alias("score")), k)


def pin_identifiers(hits: DataFrame, texts: DataFrame, tokens: Sequence[str], most: int = 10, fetch: int = 50) -> DataFrame:
    """Hits with those that hold identifiers as whole tokens first: more of them, rarer ones, then as ranked."""
    tokens = list(tokens)[:3]
    top = hits.orderBy("rank").limit(fetch).join(texts, "id")
    flags = [has_token(F.col("text"), t).cast("int") for t in tokens]
    top = top.withColumns({f"_f{i}": f for i, f in enumerate(flags)}).withColumn("_n", sum((F.col(f"_f{i}") for i in range(len(flags))), F.lit(0)))
    totals = [F.sum(f"_f{i}").over(Window.partitionBy()) for i in range(len(flags))]
    rarity = F.least(*[F.when(F.col(f"_f{i}") == 1, t) for i, t in enumerate(totals)], F.lit(2**31), F.lit(2**31))
    top = top.withColumn("_r", rarity)
    pinned = top.where("_n > 0").orderBy(F.col("_n").desc(), "_r", "rank").limit(most).select("id", "_n", "_r")
    return hits.join(pinned, "id", "left").orderBy(F.coalesce("_n", F.lit(0)).desc(), F.coalesce("_r", F.lit(2**31)), "rank").drop("_n", "_r")


def replace_superseded(hits: DataFrame, chains: DataFrame) -> DataFrame:
    """Hits replaced by their last live successors (chains: start, id, hop), which keep the better place."""
    last = chains.groupBy(F.col("start").alias("id")).agg(F.max_by(F.col("id"), "hop").alias("_to"))
    moved = hits.join(last, "id", "left").withColumn("_new", F.coalesce("_to", "id"))
    return moved.groupBy("query", F.col("_new").alias("id")).agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.max((F.col("_new") != F.col("id")).cast("int")).alias("replaced"))


def refill(direct: DataFrame, spill: DataFrame, k: int) -> DataFrame:
    """Places left free among the first k filled from the spill, in its order."""
    rest = spill.join(direct, ["query", "id"], "left_anti")
    both = direct.select("query", "id", F.lit(0).alias("_s"), "rank").unionByName(rest.select("query", "id", F.lit(1).alias("_s"), "rank"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("_s", "rank", "id"))).where(F.col("place") <= k).select("query", "id", F.col("place").alias("rank"))


def after_corrections(hits: DataFrame, corrects: DataFrame) -> DataFrame:
    """Corrected notes (corrects: id corrects target) right after what corrects them, brought in where absent."""
    pairs = hits.join(corrects, "id").select("query", F.col("target").alias("id"), F.col("rank").alias("_r"))
    first = pairs.groupBy("query", "id").agg(F.min("_r").alias("_r"))
    placed = hits.join(first, ["query", "id"], "full_outer").select("query", "id", F.coalesce("_r", "rank").alias("_at"), F.col("_r").isNotNull().cast("int").alias("_after"))
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("_at", "_after", "id"))).select("query", "id", "rank")


def related(hits: DataFrame, neighbours: DataFrame, per_hit: int) -> DataFrame:
    """Neighbours (seed, id, depth, strength, label) of hits: score 0.3 / (1 + depth), each owned by its first seed."""
    near = neighbours.join(hits.select(F.col("query"), F.col("id").alias("seed"), F.col("rank").alias("_seed")), "seed").join(hits.select("query", "id"), ["query", "id"], "left_anti")
    owner = Window.partitionBy("query", "id").orderBy("_seed", "depth")
    owned = near.withColumn("_o", F.row_number().over(owner)).where("_o = 1")
    place = Window.partitionBy("query", "seed").orderBy("depth", F.when(F.col("depth") == 1, -F.coalesce("strength", F.lit(0.0))), "label", "id")
    return owned.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_hit).withColumn("score", 0.3 / (1 + F.col("depth"))).select("query", "seed", "id", "depth", "score", "place")


def calibrate(probes: DataFrame, minimum: int = 50, degenerate: float = 0.005) -> DataFrame:
    """One row from the probes' best scores: n, median, scale (IQR / 1.349) and status."""
    cuts = probes.agg(F.count("score").alias("n"), F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_c"))
    out = cuts.select("n", F.col("_c")[1].alias("median"), ((F.col("_c")[2] - F.col("_c")[0]) / 1.349).alias("scale"))
    return out.withColumn("status", F.when(F.col("n") < minimum, "too_few").when(F.col("scale") < degenerate, "degenerate").otherwise("ready"))


def term_coverage(hits: DataFrame, texts: DataFrame, query_terms: dict[str, float], top: int = 5) -> DataFrame:
    """query, coverage: weighted share of the terms found in the texts of the first hits."""
    joined = hits.where(F.col("rank") <= top).join(texts, "id").groupBy("query").agg(F.concat_ws(" ", F.collect_list("text")).alias("_t"))
    whole = sum(query_terms.values()) or 1.0
    held = sum((F.when(F.lower("_t").contains(t.lower()), F.lit(w)).otherwise(0.0) for t, w in query_terms.items()), F.lit(0.0))
    return joined.select("query", (held / whole).alias("coverage"))


def abstain(best: DataFrame, calibration: DataFrame, floor: float = 2.0, margin: float = 2.5, coverage: float = 0.1) -> DataFrame:
    """query, z, abstain: too near to what unrelated texts score, or too few of the query's terms; an exact identifier rescues.

    best: query, score, coverage, exact_identifier; calibration: one row.
    """
    z = (F.col("score") - F.col("median")) / F.col("scale")
    out = best.crossJoin(F.broadcast(calibration)).withColumn("z", F.when(F.col("status") == "ready", z))
    weak = (F.col("z") < floor) | ((F.col("z") < floor + margin) & (F.col("coverage") < coverage))
    return out.select("query", "z", F.coalesce(weak & ~F.col("exact_identifier"), F.lit(False)).alias("abstain"))


def rerank(hits: DataFrame, texts: DataFrame, scorer, top: int = 10, size: int = 1000, overlap: int = 200, margin: float = 1.0) -> DataFrame:
    """The first hits reordered by the best piece under a scorer, a function of the Columns (query text, piece).

    A hit moves past the first only if it scores higher by the margin.
    """
    cut = hits.where(F.col("rank") <= top).join(texts, "id").withColumn("_p", F.explode(char_windows(F.col("text"), size, overlap)))
    scored = cut.groupBy("query", "id", "rank").agg(F.max(scorer(F.col("query"), F.col("_p"))).alias("_s"))
    lead = F.first("_s").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gated = scored.withColumn("_g", F.when((F.col("rank") == 1) | (F.col("_s") >= lead + margin), F.col("_s")).otherwise(F.least("_s", lead - 1e-9)))
    again = gated.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("_g").desc(), "rank"))).select("query", "id", "rank")
    return again.unionByName(hits.where(F.col("rank") > top).select("query", "id", "rank"))


def present(hits: DataFrame, texts: DataFrame, length: int = 120, full_at: float = 0.85, full_most: int = 3) -> DataFrame:
    """Hits with a confidence (1.0, 0.7 or 0.4 at scores of 0.82 and 0.65), a snippet, and whole texts of the surest few."""
    from quern.functions.scalar import estimate_tokens, snippet

    full = (F.col("score") >= full_at) & (F.col("rank") <= full_most)
    out = hits.join(texts, "id")
    return out.withColumns({"confidence": F.when(F.col("score") >= 0.82, 1.0).when(F.col("score") >= 0.65, 0.7).otherwise(0.4), "snippet": snippet(F.col("text"), length), "body": F.when(full, F.col("text")), "tokens": estimate_tokens(F.when(full, F.col("text")).otherwise(snippet(F.col("text"), length)))}).drop("text")


def deferred_matches(nodes: DataFrame, paths: Sequence[str], topics: Sequence[str]) -> DataFrame:
    """Deferred nodes whose file paths or topics match, oldest first."""

    def under(x: str) -> Column:
        return F.exists("paths", lambda p: p.startswith(x))

    def about(x: str) -> Column:
        return F.exists("topics", lambda t: F.lower(t).contains(x.lower()))

    condition = F.lit(False)
    for c in [*map(under, paths), *map(about, topics)]:
        condition = condition | F.coalesce(c, F.lit(False))
    return nodes.where(F.col("type").startswith("deferred") & condition).orderBy("created_at", "id")


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: queries, hit@k, recall@k, precision@k, MRR and nDCG of ranked (query, id, rank) against gold (query, id)."""
    judged = gold.withColumn("_g", F.lit(1)).join(ranked.where(F.col("rank") <= k), ["query", "id"], "left")
    dcg = F.sum(F.when(F.col("rank").isNotNull(), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    one = judged.groupBy("query").agg(F.count("*").alias("n"), F.count("rank").alias("h"), F.min("rank").alias("r"), dcg.alias("d"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return one.agg(F.count("*").alias("queries"), F.avg((F.col("h") > 0).cast("double")).alias("hit"), F.avg(F.col("h") / F.col("n")).alias("recall"), F.avg(F.col("h") / k).alias("precision"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.avg(F.col("d") / ideal).alias("ndcg"))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of terms of two texts."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def selectivity_base(semantic: Column, provisional: Column, ceiling: float, matched: Column, total: Column) -> Column:
    """Base score of a candidate: its similarity, or a lexical score scaled by how selective its terms are."""
    return F.coalesce(semantic, provisional * ceiling * (1 - matched / F.greatest(total, F.lit(1))))


def capture(text: Column) -> Column:
    """Is a turn worth keeping: long enough, not a question or a greeting, and with a decision, a preference or a fact in it?"""
    flat = F.trim(F.coalesce(text, F.lit("")))
    signal = flat.rlike(r"(?i)\b(decid|prefer|always|never|remember|because|must|should|agreed|conclu|fixed|root cause|convention|important)\w*")
    return (F.size(words(flat)) >= 8) & signal & ~flat.rlike(r"(?i)^(hi|hello|thanks|thank you|ok|okay)\b") & ~flat.endswith("?")


# --- phrases, indexed vectors, embeddings ------------------------------------------


def phrase_rank(docs: DataFrame, query: str, k: int, id_column: str = "id", text: str = "text") -> DataFrame:
    """id, score: documents that hold any of the query's tokens, a token of several words as a phrase, ranked by their words.

    A word that occurs n times weighs 0.1 (1 + 1/4 + ... + 1/n^2) / 1.64493406685,
    and a document the mean over the query's words: the rank of the database's
    own full text search for queries of alternatives, over the best.
    """
    import re

    phrases = [p for p in (re.findall(r"[^\W_]+", t) for t in query.lower().split()) if p]
    held = words(F.col(text))
    if not phrases:
        return docs.select(F.col(id_column).alias("id"), F.lit(0.0).alias("score")).limit(0)
    flat = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    match = F.lit(False)
    for p in phrases:
        match = match | flat.contains(" " + " ".join(p) + " ")

    def weight(w: str) -> Column:
        n = F.size(F.filter("_w", lambda x: x == w))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))).otherwise(0.0)

    named = [w for p in phrases for w in p]
    score = sum((weight(w) for w in named), F.lit(0.0)) * 0.1 / 1.64493406685 / len(named)
    hits = docs.select(F.col(id_column).alias("id"), held.alias("_w")).where(match).select("id", score.alias("raw"))
    best = hits.agg(F.max("raw").alias("_m"))
    return hits.crossJoin(F.broadcast(best)).select("id", (F.col("raw") / F.col("_m")).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)  # one row


#: Vectors that cells are fitted on at most.
IVF_SAMPLE = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def ivf_fit(vectors: DataFrame, cells: int, id_column: str = "id", vector: str = "embedding", sample: int = IVF_SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centres of cells by spherical k-means on a sample of at most so many vectors, chosen by the hash of their ids."""
    n = vectors.count()
    share = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 32)) < int(0.95 * sample / n * (1 << 32)))
    taken = share.where(F.size(vector) > 0).orderBy(F.xxhash64(id_column)).limit(sample).select(vector).collect()
    if not taken:
        return np.zeros((0, 0))
    width = len(taken[0][0])
    m = _unit(np.array([r[0] for r in taken if len(r[0]) == width], float))
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)].copy()
    for _ in range(rounds):
        own = (m @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = m[own == c].mean(0)
        centres = _unit(centres)
    return centres


def _cells(vectors: DataFrame, centres: np.ndarray, probes: int, id_column: str, vector: str) -> DataFrame:
    kind = vectors.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data = [(n, x) for n, x in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True) if x is not None and len(x) == centres.shape[1]]
            if data:
                near = np.argsort(-(_unit(np.array([x for _, x in data], float)) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_pydict({"id": pa.array([n for n, _ in data], batch.column("id").type), "v": pa.array([x for _, x in data], pa.list_(pa.float64())), "cells": pa.array(near.tolist(), pa.list_(pa.int32()))})

    return vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>, cells array<int>")


def ivf_index(vectors: DataFrame, centres: np.ndarray, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """id, v, cell of every vector: an index to be written partitioned by cell."""
    return _cells(vectors, centres, 1, id_column, vector).select("id", "v", F.col("cells")[0].alias("cell"))


def ivf_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, query_id: str = "query", vector: str = "embedding") -> DataFrame:
    """query, id, score, rank: neighbours within the probed cells of each query; the exact ones if all cells are probed."""
    asked = _cells(queries, centres, probes, query_id, vector).select(F.col("id").alias("query"), F.col("v").alias("_q"), F.explode("cells").alias("cell"))
    from quern.functions.scalar import cosine

    scored = index.join(asked, "cell").select("query", "id", F.round(cosine(F.col("_q"), F.col("v")), 9).alias("score"))
    return head(scored, k)


def embedded(docs: DataFrame, embedder, width: int, id_column: str = "id", text: str = "text", rows: int = 64, budget: int = 1 << 20) -> DataFrame:
    """id, embedding by a function of a list of texts that gives a matrix, called with at most so many rows and bytes of text at once."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), [x or "" for x in batch.column("text").to_pylist()]
            out, held, size = [], [], 0
            for x in texts:
                if held and (len(held) == rows or size + len(x) > budget):
                    out += list(embedder(held))
                    held, size = [], 0
                held.append(x)
                size += len(x)
            out += list(embedder(held)) if held else []
            yield pa.RecordBatch.from_pydict({"id": ids, "embedding": pa.array([[float(y) for y in v] for v in out], pa.list_(pa.float64()))})

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, embedding array<double>")
