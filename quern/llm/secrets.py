"""Secret scans in DataFrame functions only.

Three fixed patterns give the base findings (see ``KINDS``); spans are code
points, end exclusive, leftmost without overlaps within a kind. The method adds
runs of 20 and more characters of a secret's alphabet that overlap no base
finding and have 20 and more characters in a row that a character Markov model
of random strings explains better than one of ordinary identifiers: their
log-likelihood ratio a character is above a threshold. Words joined to a secret
so don't hide it.

Both models are bigram models trained from labelled samples (columns text and
random). The samples of ``samples()`` are drawn by a rule from hashes of row
numbers and from the word list below; users may pass their own, of any size.
Counts are aggregated before they are shuffled, and what reaches the driver is
bounded by the square of the alphabet.

Nulls are empty texts and have no findings. Texts are scanned whole, in a time
that grows with their length, whatever they hold. Repeated rows are scanned and
returned each; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _io

# The patterns of the base findings.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio a character (in nats) from which a run is taken as random.
THRESHOLD = 0.5

# Words that the sample of ordinary identifiers is made of.
WORDS = """
account action address after alert amount answer application archive argument array article author backup batch before binary block board border
branch browser buffer build button cache camera cancel category center change channel character chapter check client close cloud cluster code
collection color column command comment commit company compile complete component config connection console content context control copy count
country create current customer data database date debug default delete delivery detail device dialog directory display document domain download
driver edit element email enable engine entity error event example exception export factory failure feature field file filter finish first folder
format frame function gallery garden gateway general global graph group handler hardware header height history holder house image import index
information input insert instance integer interface internal invoice iterator journal kernel keyboard label language layout length level library
license limit line listener local location logger manager market master matrix member memory message method metric middle mobile model module
monitor music name network newsletter node notification number object offset online operation option order output owner package page parameter
parent partition password path pattern payment person picture player plugin point policy position prefix previous price printer private process
product profile project property protocol provider public query question queue random range rating reader record reference region register release
remote report request resource response result review right router sample schedule schema screen script search second secret section security
select sequence server service session setting shadow simple single socket source special standard state static station status storage stream
string student style subject suffix summary support switch symbol system table target template terminal test theme thread ticket time title token
total trace traffic transaction transfer tutorial type unique update upload user utility validate value variable vector vehicle version video view
virtual visible volume warning water weather website weight width window winter worker writer yellow zone nicht einer werden haben durch pour dans
avec elle nous vous para como pero sobre todo cuando
""".split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n random strings (hexadecimal, base 64, letters with digits) and n identifiers, paths and slugs."""
    ids = spark.range(n)
    code = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")).cast("binary"), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(code)), "[=]+$", "")
    random = F.when(F.col("id") % 4 == 0, F.substring(code, 1, 40)).when(F.col("id") % 4 == 1, F.substring(base64, 1, 44)).when(F.col("id") % 4 == 2, F.regexp_replace(base64, "[+/]", "")).otherwise(F.upper(F.regexp_replace(base64, "[+/]", "")))
    words = F.split(F.lit(" ".join(WORDS)), " ")

    def word(i: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(len(WORDS))) + 1).cast("int"))

    number = F.pmod(F.xxhash64("id"), F.lit(2100)).cast("string")
    four = [word(i) for i in range(4)]
    ordinary = (
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", *four, number))
        .when(F.col("id") % 6 == 1, F.concat(four[0], *[F.initcap(w) for w in four[1:]], number))
        .when(F.col("id") % 6 == 2, F.concat_ws("-", *four, number))
        .when(F.col("id") % 6 == 3, F.concat_ws("/", *four, number))
        .when(F.col("id") % 6 == 4, F.upper(F.concat_ws("_", *four, number)))
        .otherwise(F.concat(*four))
    )
    return ids.select(random.alias("text"), F.lit(True).alias("random")).union(ids.select(ordinary.alias("text"), F.lit(False).alias("random")))


def _chars(text: Column) -> Column:
    """Places of the text's characters in ALPHABET, from 1; 0 for others."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(labelled: DataFrame) -> list[float]:
    """Ratios of log-probability of a character after another, by (before * size + after); before is 0 at the start.

    Without samples of either kind all ratios are of uniform models, 0.
    """
    size = len(ALPHABET) + 1
    codes = F.concat(F.array(F.lit(0)), _chars(F.col("text")))
    pairs = labelled.where("text is not null and random is not null").select("random", F.explode(F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * size + b)).alias("pair"))
    counts = {True: [0] * size**2, False: [0] * size**2}
    for row in pairs.groupBy("random", "pair").count().collect():  # at most twice the square of the alphabet
        counts[row["random"]][row["pair"]] = row["count"]
    out = [0.0] * size**2
    for before in range(size):
        span = slice(before * size, (before + 1) * size)
        total = {k: sum(v[span]) for k, v in counts.items()}
        for pair in range(span.start, span.stop):
            a, b = ((counts[k][pair] + 0.5) / (total[k] + 0.5 * size) for k in (True, False))
            out[pair] = math.log(a / b)
    return out


def ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio a character of random over ordinary."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to one literal
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(_chars(text), start, lambda s, c: F.struct((s["sum"] + F.element_at(table, s["last"] * size + c + 1)).alias("sum"), c.alias("last")), lambda s: s["sum"] / F.greatest(F.length(text), F.lit(1)))


def best(text: Column, model: list[float], threshold: float, least: int = 20) -> Column:
    """The highest sum over at least so many characters in a row of their log-likelihood ratios less the threshold.

    It is above 0 where a stretch of the text is random by more than the
    threshold, whatever words are joined to it. Repeated characters and
    separators in a row are no sign of it.
    """
    size = len(ALPHABET) + 1
    table = [x - threshold for x in model]
    for c in range(1, size):
        table[c * size + c] = min(table[c * size + c], -threshold)
    marks = [ALPHABET.index(c) + 1 for c in "+/_=-"]
    for a in marks:
        for b in marks:
            table[a * size + b] = -5.0
    scores = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    codes = F.concat(F.array(F.lit(0)), _chars(text))

    def walk(c: Column) -> Column:
        at = lambda i: F.element_at(scores, F.element_at(c, F.greatest(i, F.lit(1))) * size + F.element_at(c, F.greatest(i, F.lit(1)) + 1) + 1)

        def step(acc: Column, i: Column) -> Column:
            score = at(i)
            last = acc["last"] + score - F.when(i > least, at(i - least)).otherwise(0.0)  # of the last characters
            end = F.when(i < least, F.lit(-1e9)).otherwise(F.greatest(acc["end"] + score, last))
            return F.struct(last.alias("last"), end.alias("end"), F.greatest(acc["most"], end).alias("most"))

        start = F.struct(F.lit(0.0).alias("last"), F.lit(-1e9).alias("end"), F.lit(-1e9).alias("most"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), start, step, lambda acc: acc["most"])

    return F.when(F.length(text) >= least, F.element_at(F.transform(F.array(codes), walk), 1)).otherwise(-1e9)


#: Matches whose places are summed up one after another; blocks of so many are then put in their places.
STRIDE = 128


def let(value: Column, body) -> Column:
    """body of a value that is computed once, whatever often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _below(parts: Column, zero: Column) -> Column:
    """The sum of all before each of an array's numbers, and of all."""
    return F.aggregate(parts, F.array(zero), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """start, kind, end of the leftmost non-overlapping matches of pattern that keep holds for.

    Places are sums of the lengths of what lies between matches and of the
    matches, block by block, so that time grows with the text's length; a text
    without matches that are kept isn't split.
    """
    zero = F.lit(0).cast("bigint")
    nothing = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")

    def placed(found: Column, kept: Column) -> Column:
        def sized(between: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct(F.length(F.element_at(between, i + 1)).alias("gap"), F.length(m).alias("size"), F.element_at(kept, i + 1).alias("kept")))

        def blocks(sizes: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STRIDE).cast("int")), lambda b: F.slice(sizes, b * STRIDE + 1, F.lit(STRIDE)))

        def within(block: Column, begin: Column) -> Column:
            lengths = F.transform(block, lambda x: (x["gap"] + x["size"]).cast("bigint"))
            ends = lambda below: F.transform(block, lambda x, i: F.struct((begin + F.element_at(below, i + 2) - x["size"]).alias("start"), F.lit(kind).alias("kind"), (begin + F.element_at(below, i + 2)).alias("end"), x["kept"].alias("kept")))
            return let(_below(lengths, zero), ends)

        def all_of(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda n, x: n + x["gap"] + x["size"]))
            return let(_below(totals, zero), lambda begins: F.flatten(F.transform(parts, lambda p, b: within(p, F.element_at(begins, b + 1)))))

        every = let(F.split(text, pattern, -1), lambda between: let(sized(between), lambda sizes: let(blocks(sizes), all_of)))
        return F.transform(F.filter(every, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    def matched(found: Column) -> Column:
        return let(F.transform(found, keep), lambda kept: F.when(F.exists(kept, lambda k: k), placed(found, kept)).otherwise(nothing))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, matched(found)).otherwise(nothing))


def apart(runs: Column, base: Column) -> Column:
    """The runs (disjoint, in order) that overlap none of base.

    A run overlaps none if as many of base begin before its end as end before
    its start. Both numbers are ranks in a sorted array of both.
    """
    place = lambda at, run, number: F.struct(at.cast("bigint").alias("at"), F.lit(number).alias("order"), F.lit(run).alias("run"))

    def ranks(of_runs: Column, of_base: Column) -> Column:
        order = F.array_sort(F.concat(of_runs, of_base))
        return F.transform(F.filter(F.transform(order, lambda x, i: F.struct(x["run"].alias("run"), i.alias("i"))), lambda x: x["run"]), lambda x, j: x["i"] - j)

    begun = ranks(F.transform(runs, lambda s: place(s["end"], True, 0)), F.transform(base, lambda b: place(b["start"], False, 1)))
    ended = ranks(F.transform(runs, lambda s: place(s["start"], True, 1)), F.transform(base, lambda b: place(b["end"], False, 0)))
    free = lambda x: F.filter(F.transform(runs, lambda s, i: F.struct(s.alias("s"), (F.element_at(x["begun"], i + 1) == F.element_at(x["ended"], i + 1)).alias("free"))), lambda y: y["free"])
    some = F.transform(let(F.struct(begun.alias("begun"), ended.alias("ended")), free), lambda y: y["s"])
    return F.when((F.size(runs) > 0) & (F.size(base) > 0), some).otherwise(runs)


def rendered(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with columns base and found: arrays of (start, kind, end), of the patterns and with the model's findings.

    Columns of these names are replaced; other names can't clash.
    """
    source = _io.packed(docs).withColumn("text", F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit("")))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    random = lambda m: best(m, model, threshold) > 0
    every = lambda m: F.lit(True)
    for i, (pattern, keep) in enumerate(((ASSIGN, value), (ACCESS, every), (HEX, every), (CANDIDATE, random))):
        source = source.withColumn(f"k{i}", spans(F.col("text"), pattern, i, keep))
    out = source.withColumn("base", F.array_sort(F.concat("k0", "k1", "k2"))).withColumn("found", F.array_sort(F.concat("base", apart(F.col("k3"), F.col("base")))))
    return _io.widened(out, docs.columns, {"base": F.col("base"), "found": F.col("found")})


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    model = train(samples(spark))
    found = scan(_io.table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(rendered("base").cast("binary"), 256).alias("base_sha256"),
        rendered("found").alias("spans"),
    )
