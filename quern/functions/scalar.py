"""Scalar functions as native Column expressions (and a few of the driver's strings)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Words that carry no topic in keyword queries. Which documents match a query depends on them.
STOP_WORDS = """
a an the and or but if so of in on at to for by with from as is are was were be been do does did have has had not no we i you it he she they this that
these those what which who whom how when where why about into our your their its my me us them any all
""".split()

# --- text ---------------------------------------------------------------


@pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s) if s is not None and not s.isascii() else s)


def alias_normalise(text: Column, compatibility: bool = False) -> Column:
    """Lower case, apostrophes dropped, other punctuation to single spaces.

    compatibility: NFKC first, by Arrow batches; the native form is exact for ASCII.
    """
    text = _nfkc(text) if compatibility else text
    plain = F.regexp_replace(F.lower(text), "['’‘`´]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def normalise_tag(tag: Column) -> Column:
    return F.lower(F.trim(tag))


def tags_to_array(text: Column) -> Column:
    """A comma list as distinct normalised tags, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), normalise_tag), lambda t: t != ""))


def tags_to_text(tags: Column) -> Column:
    return F.array_join(tags, ",")


def sanitise_identifier(text: Column, fallback: str = "column") -> Column:
    """Letters, digits and underscores only, none of these at the ends, and no digit first."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    plain = F.when(plain == "", F.lit(fallback)).otherwise(plain)
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keyword_terms(query: str, most: int = 8) -> list[str]:
    """Distinct words of two and more characters that aren't stop words, the longest ones where there are more than most.

    A query of other words only is taken by all of its words, one without words as a whole; a blank one has none.
    """
    plain = query.lower().strip()
    found = list(dict.fromkeys(re.findall(r"[^\W_]+", plain))) or [plain] * bool(plain)
    kept = [w for w in found if len(w) >= 2 and w not in STOP_WORDS] or found
    return kept if len(kept) <= most else sorted(kept, key=len, reverse=True)[:most]


def light_stem(word: Column) -> Column:
    """ies to y; ing, ed, es or ly off what leaves four characters; plural s; then a final e."""
    w = F.lower(word)
    cut = F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
    for end in ("ing", "ed", "es", "ly"):
        cut = cut.when(w.endswith(end) & (F.length(w) - len(end) >= 4), F.substring(w, F.lit(1), F.length(w) - len(end)))
    cut = cut.when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) >= 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.when((F.length(cut) > 4) & cut.endswith("e"), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


#: What looks like code: #12, dotted, snake, slashed or hyphenated names, camel case, and six and more characters with a digit.
IDENTIFIER = r"#\d+|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+|[A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{6,}"


def identifier_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)))


def strong_identifier(token: Column) -> Column:
    """Shaped like code beyond doubt: an issue number, a path, a snake or long camel name, or letters after digits."""
    hyphens = token.contains("-") & token.rlike(r"\d") & (F.size(F.split(token, "-")) >= 3)
    dots = token.contains(".") & ((F.size(F.split(token, r"\.")) >= 3) | token.rlike("^[a-z]") | token.rlike("[a-z][A-Z]"))
    camel = ~token.contains(".") & (token.rlike("^[a-z]{2,}[a-z0-9]*[A-Z][a-z]") | token.rlike("^(?:[A-Z][a-z0-9]+){3,}$") | ((F.length(token) >= 6) & token.rlike("[0-9][A-Za-z]")))
    return token.rlike(r"^#\d+$") | token.contains("_") | token.contains("/") | hyphens | dots | camel


def has_token(text: Column, token: str) -> Column:
    """The token occurs, bounded where its own ends are word characters; case doesn't matter."""
    left = r"(?<![\p{L}\p{N}_])" if re.match(r"\w", token) else ""
    right = r"(?![\p{L}\p{N}_])" if re.search(r"\w$", token) else ""
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + left + re.escape(token).replace("'", r"\x27") + right)


def cjk_share(text: Column) -> Column:
    """Share of Han, kana and hangul among the letters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")) / F.nullif(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0)), F.lit(0.0))


# Frequent short words by language, for detection.
LANGUAGE_WORDS = {
    "de": "der die das und ist nicht ein eine zu mit von den im sich auf für dem des auch als",
    "en": "the of and to in is that for it was on are as with his they at be this from",
    "es": "el la de que y en un ser se no los las por con su para como del una al",
    "fr": "le la les de des et un une est que dans pour pas sur qui au par avec du en",
}


def detect_language(text: Column, shortest: int = 20, threshold: float = 0.03) -> Column:
    """(language, confidence): share of words that are frequent in a language, top minus runner-up; und where unsure."""
    found = words(text)
    n = F.greatest(F.size(found), F.lit(1))

    def share(known: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(known))) / n

    shares = F.array(*[F.struct(share(known.split()).alias("share"), F.lit(code).alias("language")) for code, known in LANGUAGE_WORDS.items()])
    ranked = F.reverse(F.array_sort(shares))
    gap = F.round(ranked[0]["share"] - ranked[1]["share"], 6)
    sure = (F.length(text) >= shortest) & (gap >= threshold)
    return F.struct(F.when(sure, ranked[0]["language"]).otherwise("und").alias("language"), F.coalesce(gap, F.lit(0.0)).alias("confidence"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def snippet(text: Column, length: int = 120) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length), F.lit("…")))


def closest(word: Column, known: list[str], most: int = 3) -> Column:
    """The known name of least edit distance (first by text among equals), null beyond most."""
    scored = F.array(*[F.struct(F.levenshtein(word, F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in known])
    best = F.array_min(scored)
    return F.when(best["d"] <= most, best["k"])


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in order."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def char_windows(text: Column, size: int = 480, overlap: int = 120) -> Column:
    """Windows of size characters, each overlapping the one before; the last may be shorter."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def cap_text(text: Column, most: int = 10 << 20, mark: str = "\n[truncated]") -> Column:
    """Text of at most so many UTF-8 bytes, whole characters, with a mark where it was cut."""
    # a cut within a character decodes to U+FFFD at the end, which goes
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit(mark)))


# --- vectors, JSON, patterns ---------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def json_list(column: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(column, path), "array<string>"), F.array().cast("array<string>"))


@pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON with sorted keys and no white space; text that isn't JSON stays."""
    import json

    def one(s):
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return s

    return values.map(one)


def glob_match(text: Column, patterns: list[str]) -> Column:
    """Any of the patterns, in which a star stands for anything; case doesn't matter."""
    if not patterns:
        return F.lit(False)
    return text.rlike("(?is)^(" + "|".join(".*".join(map(re.escape, p.split("*"))) for p in patterns) + ")$")


# --- ranking ---------------------------------------------------------------

# Factors of the rank score.
CURATED_TYPES = ("decision", "architecture", "convention", "bug_pattern")
TYPE_BIAS, CURATION, HALF_LIFE_DAYS, RECENCY_FLOOR = 1.5, 1.2, 30.0, 0.85


def recency_decay(updated: Column, today: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """exp(-days / half life); 1 without a time. Days are whole UTC days of the clock."""
    age = F.greatest((F.unix_timestamp(F.date_trunc("day", today)) - F.unix_timestamp(updated)) / 86_400.0, F.lit(0.0))
    return F.coalesce(F.exp(-age / half_life), F.lit(1.0))


def outcome_weight(success: Column, failure: Column, partial: Column, score: Column) -> Column:
    """More for confirmed and for failure-prone knowledge, growing to full weight at five outcomes."""
    total = success + failure + partial
    full = F.least(total / 5.0, F.lit(1.0))
    return F.when(total > 0, 1 + 0.5 * (failure / total) * full + 0.2 * score * full).otherwise(1.0)


def type_bias(kind: Column) -> Column:
    return F.when(kind.isin(*CURATED_TYPES), TYPE_BIAS).otherwise(1.0)


def curation_boost(curated: Column) -> Column:
    return F.when(curated, CURATION).otherwise(1.0)


def rank_score(base: Column, kind: Column, updated: Column, today: Column, curated: Column, outcome: Column) -> Column:
    return base * type_bias(kind) * (RECENCY_FLOOR + (1 - RECENCY_FLOOR) * recency_decay(updated, today)) * curation_boost(curated) * outcome


def z_score(value: Column, median: Column, scale: Column) -> Column:
    return (value - median) / scale


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


# --- language by trigrams ------------------------------------------------------------

#: Trigrams of a language's profile.
PROFILE = 300


def _padded_trigrams(text: Column) -> Column:
    """Runs of three characters of lower-case letters and single spaces, with a space at both ends."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))
    # characters are cut once, so that time grows with the text's length
    run = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.concat(x, F.element_at(c, i + 2), F.element_at(c, i + 3)))
    return F.element_at(F.transform(F.array(F.filter(F.split(flat, ""), lambda x: x != "")), run), 1)


def language_profiles(samples, language: str = "lang", text: str = "text") -> dict[str, list[str]]:
    """The most frequent trigrams of each language of labelled texts, most frequent first."""
    from pyspark.sql import Window

    counted = samples.select(F.col(language).alias("l"), F.explode(_padded_trigrams(F.col(text))).alias("t")).where("l is not null and length(trim(t)) > 0").groupBy("l", "t").agg(F.count("*").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.col("n").desc(), "t"))).where(F.col("r") <= PROFILE)
    out: dict[str, list[str]] = {}
    for r in best.orderBy("l", "r").collect():  # a profile a language
        out.setdefault(r["l"], []).append(r["t"])
    return out


def trigram_language(text: Column, profiles: dict[str, list[str]], shortest: int = 20, threshold: float = 0.01) -> Column:
    """(language, confidence): nearest profile by how far the text's trigrams stand from their places in it; und where unsure."""
    places = {code: {t: i for i, t in enumerate(p)} for code, p in profiles.items()}

    @pandas_udf("language string, confidence double")
    def detect(values: pd.Series) -> pd.DataFrame:
        from collections import Counter

        rows = []
        for value in values:
            flat = f" {' '.join(re.findall(r'[^\W\d_]+', (value or '').lower()))} "
            counts = Counter(flat[i : i + 3] for i in range(len(flat) - 2))
            ranked = sorted(counts, key=lambda t: (-counts[t], t))[:PROFILE]
            most = PROFILE * max(len(ranked), 1)
            near = sorted(((1 - sum(abs(own[t] - i) if t in own else PROFILE for i, t in enumerate(ranked)) / most, code) for code, own in places.items()), key=lambda x: (-x[0], x[1]))
            gap = near[0][0] - near[1][0] if len(near) > 1 else 1.0
            sure = near and len(value or "") >= shortest and gap >= threshold
            rows.append((near[0][1] if sure else "und", round(gap, 6)))
        return pd.DataFrame(rows, columns=["language", "confidence"])

    return detect(text)
