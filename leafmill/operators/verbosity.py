"""Verbosity of pages: metrics, rules, scores, corpus percentiles, and rewrites compared.

Rules are data: code, condition, value, threshold and message. They become one array expression,
so a page's reasons come out of the same projection as its metrics, without a join.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions import text as T
from ..sources.store import cut
from .chunks import sections_of

WEIGHTS = {
    "line_count_high": 0.22, "section_too_long": 0.20, "understructured_long_page": 0.14, "wall_of_text": 0.14, "repeated_5grams": 0.12,
    "near_duplicate_sentences": 0.12, "word_count_high": 0.10, "line_count_warning": 0.10, "low_lexical_density": 0.06,
}
_OTHER = 0.08


@dataclass(frozen=True)
class Profile:
    """Thresholds; the defaults are the stock ones."""

    name: str = "default"
    lines_warn: int = 200
    lines_hard: int = 300
    section_warn: int = 80
    section_hard: int = 120
    min_links: int = 2
    sentence_words: float = 28.0
    long_sentence: int = 30
    long_share: float = 0.25
    extreme_sentence: int = 80
    repeat5: float = 0.08
    near_dup: float = 0.10
    unique_content: float = 0.36
    density: float = 0.42
    gzip: float = 0.35
    lines_per_heading: int = 80
    words: int = 3000


@F.pandas_udf(DoubleType())
def gzip_ratio(texts: pd.Series) -> pd.Series:
    """Compressed bytes per byte; an empty text counts as 1. Spark has no such function."""
    raw = [(t or "").encode() for t in texts]
    return pd.Series([len(gzip.compress(b, mtime=0)) / len(b) if b else 1.0 for b in raw], dtype="float64")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sections(body: Column, front_lines: Column) -> Column:
    """array<struct<heading, level, text, start_line, end_line, line_count>>; a body without headings
    is one section of level 0, an empty one has none."""
    stripped = _strip(body)
    def row(s: Column) -> Column:
        a, b = s["start"] + front_lines, s["end"] + front_lines
        return F.struct(s["heading"].alias("heading"), s["level"].alias("level"), s["text"].alias("text"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), F.greatest(b - a + 1, F.lit(1)).cast("int").alias("line_count"))

    n = T.line_count(stripped)
    whole = F.struct(F.lit("(document)").alias("heading"), F.lit(0).alias("level"), stripped.alias("text"), (front_lines + 1).cast("int").alias("start_line"), (front_lines + n).cast("int").alias("end_line"), n.cast("int").alias("line_count"))
    found = F.transform(sections_of(stripped), row)
    none = F.slice(F.array(whole), 1, 0)
    return F.when(stripped == "", none).when(F.regexp_count(stripped, F.lit(T.HEADING)) > 0, found).otherwise(F.array(whole))


def content_sets(sentences: Column) -> Column:
    """The sets of content tokens, as hashes, of the sentences that have four or more."""
    return F.filter(F.transform(sentences, lambda s: F.array_distinct(T.hashes(T.without_stopwords(T.tokens(s))))), lambda t: F.size(t) >= 4)


def near_duplicate_ratio(sets: Column, window: int = 40, least: float = 0.82) -> Column:
    """Share of sentence pairs, no more than ``window`` apart, whose token sets overlap so far.
    sets: a column that holds content_sets, so that they are made once."""

    def alike(a: Column, b: Column) -> Column:
        fit = F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b))
        return F.when(fit, T.jaccard(a, b) >= least).otherwise(F.lit(False))

    hits = F.transform(sets, lambda a, i: F.size(F.filter(F.slice(sets, i + 2, F.lit(window)), lambda b: alike(a, b))))
    n = F.size(sets)
    checks = F.when(n > window, window * n - window * (window + 1) / 2).otherwise(n * (n - 1) / 2)
    return F.aggregate(hits, F.lit(0), lambda x, y: x + y) / F.greatest(checks, F.lit(1))


def heading_repetition(secs: Column) -> Column:
    """Share of heading words that stand six times or more in their section, heading included."""
    words = lambda s: F.transform(T.without_stopwords(T.tokens(s["heading"])), lambda t: (T.size_of(T.tokens(s["text"]), t) >= 6).cast("int"))
    marks = F.flatten(F.transform(secs, words))
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(marks), F.lit(1))


def top_phrases(rows: DataFrame, key: str, n: int = 5, top: int = 5) -> DataFrame:
    """(key, tokens) to the most frequent n-grams of each key, the earlier first among equals. What
    is not repeated, or only stop words, leaves after the cut. Rows without a repeat send nothing, the
    others hashes and places; the phrases of what is left are cut from the tokens."""
    grams = rows.select(key, T.ngram_hashes(T.hashes(F.col("tokens")), n).alias("g")).where(F.size(F.array_distinct("g")) < F.size("g"))
    counted = grams.select(key, F.posexplode("g").alias("at", "h")).groupBy(key, "h").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first")).where("count > 1")
    order = Window.partitionBy(key).orderBy(F.desc("count"), "first")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(rows.select(key, "tokens"), key).withColumn("words", F.slice("tokens", F.col("first") + 1, n))
    return named.where(F.size(T.without_stopwords(F.col("words"))) > 0).select(key, "rank", F.array_join("words", " ").alias("phrase"), "count")


def computed(rows: DataFrame) -> DataFrame:
    """rows, with no filter pushed below this point: pushed down, a condition would be written out
    in terms of the first columns, and every metric in it would be computed again and again."""
    packed = F.explode_outer(F.array(F.struct(*[F.col(c) for c in rows.columns]))).alias("r")
    return rows.select(packed).select("r.*")


_DOUBLES = (
    "avg_section_lines", "lines_per_heading", "bullet_line_ratio", "table_line_ratio", "code_line_ratio", "avg_sentence_words", "long_sentence_ratio", "avg_word_chars", "ari_score", "repeated_5gram_ratio",
    "repeated_8gram_ratio", "near_duplicate_sentence_ratio", "heading_repetition_ratio", "gzip_ratio", "unique_token_ratio", "unique_content_word_ratio", "lexical_density", "stopword_ratio",
)
METRICS = (
    "line_count", "body_line_count", "word_count", "char_count", "heading_count", "max_section_lines", "avg_section_lines", "lines_per_heading", "bullet_line_ratio", "table_line_ratio", "code_line_ratio",
    "wikilink_count", "markdown_link_count", "sentence_count", "avg_sentence_words", "max_sentence_words", "long_sentence_count", "long_sentence_ratio", "avg_word_chars", "ari_score", "repeated_5gram_ratio",
    "repeated_8gram_ratio", "near_duplicate_sentence_ratio", "heading_repetition_ratio", "gzip_ratio", "unique_token_ratio", "unique_content_word_ratio", "lexical_density", "stopword_ratio",
)
_SECTION = "heading string, level int, text string, start_line int, end_line int, line_count int"
#: What a page without a text has; the rest is null.
_NO_TEXT = {"avg_sentence_words": 0.0, "max_sentence_words": 0, "near_duplicate_sentence_ratio": 0.0, "heading_repetition_ratio": 0.0}
#: Pages that become one batch of results.
_SLICE = 256


def metrics(pages: DataFrame, profile: Profile = Profile(), include_code: bool = False, with_gzip: bool = True) -> DataFrame:
    """pages (path, text, body, frontmatter_lines) with all metrics, and the sections.

    One Arrow stage reads each page once; as it is no expression, nothing that comes after it, filters
    and joins included, makes it run twice in a row.
    """
    kinds = ", ".join(f"{m} {'double' if m in _DOUBLES else 'int'}" for m in METRICS)
    # a body that is the whole text crosses once
    rows = pages.select("path", F.when(F.col("text") != F.col("body"), F.col("text")).alias("text"), "body", "frontmatter_lines")
    schema = rows.sparkSession.range(0).select(F.lit(None).cast(rows.schema["path"].dataType).alias("path"), F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in kinds.split(', '))}>").alias("m"), F.lit(None).cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _SECTION.split(', '))}>>").alias("sections"))
    schema = schema.select("path", "m.*", "sections").schema
    long, arrow = profile.long_sentence, to_arrow_schema(schema)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {m: [] for m in METRICS}
        secs = []
        for text, body, front in zip(*(batch.column(c).to_pylist() for c in ("text", "body", "frontmatter_lines"))):
            found, own, prose = (_NO_TEXT, None, "") if body is None else kernels.metrics(body if text is None else text, body, front, long, include_code)
            for m, c in columns.items():
                c.append(found.get(m))
            if with_gzip:
                raw = prose.encode()
                columns["gzip_ratio"][-1] = len(gzip.compress(raw, mtime=0)) / len(raw) if raw else 1.0
            secs.append(own)
        return pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array(columns[m], arrow.field(m).type) for m in METRICS], pa.array(secs, arrow.field("sections").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                yield measure(b.slice(at, _SLICE))

    return rows.mapInArrow(run, schema)


THREE_PLACES = ("avg_section_lines", "lines_per_heading", "avg_sentence_words", "avg_word_chars", "ari_score")
SIX_PLACES = (
    "bullet_line_ratio", "table_line_ratio", "code_line_ratio", "long_sentence_ratio", "repeated_5gram_ratio", "repeated_8gram_ratio", "near_duplicate_sentence_ratio",
    "heading_repetition_ratio", "gzip_ratio", "unique_token_ratio", "unique_content_word_ratio", "lexical_density", "stopword_ratio",
)
COUNTS = (
    "line_count", "body_line_count", "word_count", "char_count", "heading_count", "max_section_lines", "wikilink_count", "markdown_link_count", "sentence_count", "max_sentence_words", "long_sentence_count",
)


def rounded(measured: DataFrame, *more: str) -> DataFrame:
    """The metrics as they are reported, and more columns as they are; rules work on the exact ones."""
    return measured.select("path", *more, *COUNTS, *[F.round(c, 3).alias(c) for c in THREE_PLACES], *[F.round(c, 6).alias(c) for c in SIX_PLACES])


def _reason(code: str, cond: Column, value: Column, threshold: Column | float | str, message: str, spot: Column | None = None) -> Column:
    blank = F.lit(None)
    place = [blank.cast(t).alias(k) if spot is None else spot[k].cast(t).alias(k) for k, t in (("start_line", "int"), ("end_line", "int"), ("heading", "string"))]
    limit = threshold.cast("string") if isinstance(threshold, Column) else F.lit(str(threshold))
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.round(value.cast("double"), 6).alias("value"), limit.alias("threshold"), F.lit(WEIGHTS.get(code, _OTHER)).alias("weight"), F.lit(message).alias("message"), *place))


def _listed(*reasons: Column) -> Column:
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def page_reasons(p: Profile) -> Column:
    m = F.col
    longest = F.element_at(F.filter("sections", lambda s: s["line_count"] == m("max_section_lines")), 1)
    longest = F.when(F.size(F.filter("sections", lambda s: s["line_count"] == m("max_section_lines"))) > 0, longest)
    long_page, links = m("line_count") >= p.lines_warn, m("wikilink_count") + m("markdown_link_count")
    shapes, many = m("bullet_line_ratio") + m("table_line_ratio"), m("word_count") >= 500
    wanted = F.concat(F.lit(">= "), F.format_number(m("line_count") / p.lines_per_heading, 1), F.lit(" headings"))
    return _listed(
        _reason("line_count_high", m("line_count") >= p.lines_hard, m("line_count"), p.lines_hard, "More lines than a page should have."),
        _reason("line_count_warning", long_page & (m("line_count") < p.lines_hard), m("line_count"), p.lines_warn, "Nearly too many lines for a page."),
        _reason("word_count_high", m("word_count") >= p.words, m("word_count"), p.words, "Very many words of prose."),
        _reason("section_too_long", m("max_section_lines") >= p.section_hard, m("max_section_lines"), p.section_hard, "One section is too long to scan.", longest),
        _reason("section_warning", (m("max_section_lines") >= p.section_warn) & (m("max_section_lines") < p.section_hard), m("max_section_lines"), p.section_warn, "One section should soon be split.", longest),
        _reason("understructured_long_page", long_page & (m("heading_count") < m("line_count") / p.lines_per_heading), m("heading_count"), wanted, "A long page with few headings."),
        _reason("long_page_low_links", long_page & (links < p.min_links), links, p.min_links, "A long page with few links."),
        _reason("wall_of_text", (m("line_count") >= 120) & (shapes < 0.08) & (m("heading_count") <= 2), shapes, "0.08 in lists and tables, or 3 headings", "Prose without lists, tables or headings."),
        _reason("avg_sentence_too_long", m("avg_sentence_words") >= p.sentence_words, m("avg_sentence_words"), p.sentence_words, "Sentences are long on average."),
        _reason("long_sentence_ratio_high", m("long_sentence_ratio") >= p.long_share, m("long_sentence_ratio"), p.long_share, "A large share of long sentences."),
        _reason("sentence_extreme", m("max_sentence_words") >= p.extreme_sentence, m("max_sentence_words"), p.extreme_sentence, "One sentence is extremely long."),
        _reason("repeated_5grams", m("repeated_5gram_ratio") >= p.repeat5, m("repeated_5gram_ratio"), p.repeat5, "The same runs of five words come again."),
        _reason("near_duplicate_sentences", m("near_duplicate_sentence_ratio") >= p.near_dup, m("near_duplicate_sentence_ratio"), p.near_dup, "Sentences say nearly the same."),
        _reason("low_unique_content_ratio", many & (m("unique_content_word_ratio") < p.unique_content), m("unique_content_word_ratio"), p.unique_content, "Few different content words."),
        _reason("low_lexical_density", many & (m("lexical_density") < p.density), m("lexical_density"), p.density, "Mostly function words."),
        _reason("high_compressibility", many & (m("gzip_ratio") < p.gzip), m("gzip_ratio"), p.gzip, "Compresses well, so it repeats itself."),
    )


def section_results(measured: DataFrame, p: Profile = Profile(), include_code: bool = False) -> DataFrame:
    """Of measured pages the sections with a reason, a row each; rank puts the heaviest of a page
    first, in document order among equals."""
    # outer: the optimiser then infers no filter that would repeat the whole section expression
    rows = measured.select("path", F.explode_outer("sections").alias("s")).select("path", "s.*").where(F.col("heading").isNotNull())
    rows = rows.withColumn("__text", F.col("text") if include_code else T.strip_code(F.col("text")))
    rows = rows.withColumn("tokens", T.tokens(T.strip_noise(F.col("__text")))).withColumn("__s", T.sentences(F.col("__text")))
    rows = rows.withColumn("__sl", F.filter(F.transform("__s", lambda x: F.size(T.tokens(x))), lambda n: n > 0)).withColumn("__c", T.without_stopwords(F.col("tokens"), digits=False))
    rows = rows.withColumn("average", F.aggregate("__sl", F.lit(0), lambda a, x: a + x) / F.greatest(F.size("__sl"), F.lit(1)))
    rows = rows.withColumn("repeat", T.repeated_ratio(T.ngram_hashes(T.hashes(F.col("tokens")), 5))).withColumn("unique", F.size(F.array_distinct("__c")) / F.greatest(F.size("__c"), F.lit(1)))
    rows = rows.withColumn("links", F.regexp_count("__text", F.lit(T.WIKILINK)) + F.regexp_count("__text", F.lit(T.LINK)))
    m, n = F.col, F.col("line_count")
    spot = F.struct("start_line", "end_line", "heading")
    reasons = _listed(
        _reason("section_too_long", n >= p.section_hard, n, p.section_hard, "The section is too long to scan.", spot),
        _reason("section_warning", (n >= p.section_warn) & (n < p.section_hard), n, p.section_warn, "The section should soon be split.", spot),
        _reason("avg_sentence_too_long", (F.size("__sl") > 0) & (m("average") >= p.sentence_words), F.round("average", 3), p.sentence_words, "Its sentences are long on average.", spot),
        _reason("repeated_5grams", m("repeat") >= p.repeat5, m("repeat"), p.repeat5, "The same runs of five words come again.", spot),
        _reason("low_unique_content_ratio", (F.size("tokens") >= 150) & (m("unique") < p.unique_content), m("unique"), p.unique_content, "Few different content words.", spot),
        _reason("long_page_low_links", (n >= p.section_warn) & (m("links") == 0), m("links"), 1, "A long section without links.", spot),
    )
    rows = rows.select("path", "heading", "level", "start_line", "end_line", "line_count", reasons.alias("reasons"))
    rows = computed(rows).where(F.size("reasons") > 0)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), weight_of(F.col("reasons"))), 6))
    order = Window.partitionBy("path").orderBy(F.desc("score"), "start_line")
    return rows.select("path", (F.row_number().over(order) - 1).alias("rank"), "heading", "level", "start_line", "end_line", "line_count", "score", "reasons")


def weight_of(reasons: Column) -> Column:
    return F.aggregate(reasons, F.lit(0.0), lambda a, r: a + r["weight"])


def _score(p: Profile) -> Column:
    m = F.col
    total = F.least(F.lit(1.0), weight_of(F.col("reasons")))
    structured = (m("line_count") >= p.lines_warn) & (m("heading_count") >= m("line_count") / 60) & (m("max_section_lines") < p.section_warn)
    total = F.when(structured, F.greatest(F.lit(0.0), total - 0.08)).otherwise(total)
    listed = (m("bullet_line_ratio") + m("table_line_ratio") >= 0.25) & (m("repeated_5gram_ratio") < p.repeat5)
    total = F.when(listed, F.greatest(F.lit(0.0), total - 0.05)).otherwise(total)
    floor = (m("line_count") >= p.lines_hard) | (m("max_section_lines") >= p.section_hard)
    return F.round(F.least(F.lit(1.0), F.when(floor, F.greatest(total, F.lit(0.65))).otherwise(total)), 6)


_TIME = r"(?i)\b(?:20\d{2}|history|chronology|timeline|log|session|update)\b"


def _suggestions() -> Column:
    codes = F.transform("reasons", lambda r: r["code"])
    has = lambda *names: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in names]))
    high, many = has("line_count_high"), F.col("heading_count") >= 4
    dated = F.size(F.filter("sections", lambda s: s["heading"].rlike(_TIME))) >= 2
    wide = F.size(F.filter("sections", lambda s: s["line_count"] >= 80)) >= 2
    rules = [
        ("split_by_heading", high & many), ("move_chronology_to_archive", high & dated), ("add_headings", has("understructured_long_page", "wall_of_text")),
        ("add_wikilinks", has("long_page_low_links")), ("extract_deep_dive_page", has("section_too_long")), ("create_hub_page", wide | (high & many)),
        ("deduplicate_repeated_claims", has("repeated_5grams", "near_duplicate_sentences")), ("shorten_sentences", has("avg_sentence_too_long", "long_sentence_ratio_high", "sentence_extreme")),
        ("replace_prose_with_table_or_bullets", has("low_unique_content_ratio", "low_lexical_density")),
        ("replace_with_compact_index_and_archive_original", F.col("compared") & ~has("rewrite_not_compact", "rewrite_too_destructive")),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda s: s.isNotNull())


def judge(measured: DataFrame, profile: Profile = Profile(), extra_reasons: str | None = None) -> DataFrame:
    """Measured pages with reasons, score, severity and suggestions; the sections that stand out
    are in ``section_results``. extra_reasons: a column with more reasons, such as those of a comparison; they count too."""
    own = page_reasons(profile)
    rows = measured.withColumn("reasons", own if extra_reasons is None else F.concat(own, F.col(extra_reasons)))
    rows = rows.withColumn("compared", F.lit(extra_reasons is not None)).withColumn("score", _score(profile))
    hard = F.exists("reasons", lambda r: r["code"].isin("line_count_high", "section_too_long"))
    severity = F.when((F.col("score") >= 0.65) | hard, "high").when((F.col("score") >= 0.35) | (F.size("reasons") > 0), "warning").otherwise("ok")
    rows = rows.withColumn("severity", severity).withColumn("is_verbose", F.col("severity") != "ok")
    return computed(rows.withColumn("suggestions", _suggestions()).withColumn("profile", F.lit(profile.name)).drop("compared"))


PERCENTILES = ("line_count", "max_section_lines", "word_count")


def percentiles(judged: DataFrame) -> DataFrame:
    """judged with <metric>_percentile: the share of pages with no greater value.

    The values of all metrics are counted in one pass, so that only distinct ones are put in order;
    a page then looks its values up. Counts of lines and words are few, whatever the corpus.
    """
    values = judged.select(F.explode_outer(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in PERCENTILES])).alias("x")).select("x.m", "x.v")
    order = Window.partitionBy("m").orderBy("v")
    whole = F.sum("c").over(Window.partitionBy("m"))
    shares = values.groupBy("m", "v").agg(F.count(F.lit(1)).alias("c")).select("m", "v", F.round(F.sum("c").over(order) / whole, 6).alias("share"))
    for m in PERCENTILES:
        own = shares.where(F.col("m") == m).select(F.col("v").alias(m), F.col("share").alias(f"{m}_percentile"))
        judged = judged.join(own, m)
    return judged


def audit(judged: DataFrame, limit: int = 20, severity: str | None = None) -> DataFrame:
    """The most verbose pages of one severity, or of all, with percentiles among them. The judged rows
    are written once, since percentiles read them several times: select what you need of them before."""
    if severity is not None and severity not in ("ok", "warning", "high"):
        raise ValueError("severity must be one of: ok, warning, high")
    rows = judged if severity is None else judged.where(F.col("severity") == severity)
    return percentiles(cut(rows, "audit")).orderBy(F.desc("score"), F.desc("line_count"), "path").limit(limit)


def compare(pairs: DataFrame) -> DataFrame:
    """pairs (path, source, rewrite: two bodies) with the metrics and reasons of the rewrite."""
    def parts(c: str) -> list[Column]:
        heads = F.transform(F.regexp_extract_all(F.col(c), F.lit(T.HEADING), F.lit(2)), lambda h: F.lower(_strip(h)))
        return [T.tokens(T.strip_noise(T.strip_code(F.col(c)))).alias(f"{c}_t"), F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(T.WIKILINK), F.lit(0))).alias(f"{c}_l"), F.array_distinct(heads).alias(f"{c}_h")]

    rows = pairs.select("path", *parts("source"), *parts("rewrite"))
    s, r = F.array_distinct("source_t"), F.array_distinct("rewrite_t")
    over = lambda a, b: F.size(a) / F.greatest(F.size(b), F.lit(1))
    kept_links = F.when(F.size("source_l") == 0, F.lit(1.0)).otherwise(over(F.array_intersect("source_l", "rewrite_l"), F.col("source_l")))
    rows = rows.select(
        "path", F.size("source_t").alias("source_word_count"), F.size("rewrite_t").alias("rewrite_word_count"), over(F.col("rewrite_t"), F.col("source_t")).alias("compression_ratio"),
        over(F.array_intersect(s, r), s).alias("kept_unigrams_ratio"), over(F.array_except(s, r), s).alias("deleted_unigrams_ratio"), over(F.array_except(r, s), r).alias("added_unigrams_ratio"),
        over(F.array_intersect("source_h", "rewrite_h"), F.col("source_h")).alias("heading_preservation_ratio"), kept_links.alias("wikilink_preservation_ratio"),
    )
    ratio, heads, links = F.col("compression_ratio"), F.col("heading_preservation_ratio"), F.col("wikilink_preservation_ratio")
    reasons = _listed(
        _reason("rewrite_not_compact", ratio > 0.75, ratio, 0.75, "The rewrite is hardly shorter."),
        _reason("rewrite_too_destructive", (heads < 0.5) | (links < 0.5), F.least(heads, links), ">= 0.5", "The rewrite loses headings or links."),
    )
    names = [c for c in rows.columns if c.endswith("_ratio")]
    return rows.withColumn("compare_reasons", reasons).withColumns({c: F.round(c, 6) for c in names})
