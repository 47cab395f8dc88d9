"""Queries whose work must grow no faster than their tables: how often a plan does its costly step, and
the kernels against the Column expressions that they stand for."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from leafmill.functions import kernels as K
from leafmill.functions import text as T
from leafmill.operators import embed, search, sections, semantic
from leafmill.operators import verbosity as V
from leafmill.plans import catalog

BITS = [
    "# H", "## Sub  ", "\n", "\n\n", "\r\n", "\r", " ", "\x85", "\x0b", " ", "  ", "\t", "    code", "```", "~~~py", "- item", "* x", "12. n", "| a | b |", "---", "[[A|b]]", "[l](u)", "![i](p)", "`c`",
    "Word", "the", "of", "alpha", "beta", "gamma", "delta", "document", "Kk", "İx", "é", "한다 단어", "12", "1.5", ". ", "! ", "。 ", "; ", ".", "#", "\x1c", "\n# H\n", "\n- ",
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    texts = [r.choice(["", " ", "\n"]).join(r.choice(BITS) for _ in range(r.choice([0, 1, 5, 20, 90]))) for _ in range(400)]
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string").cache()


def test_kernels_say_what_columns_say(odd):
    t = F.col("text")
    rows = odd.select("text", T.tokens(t).alias("tokens"), T.strip_noise(t).alias("noise"), T.strip_code(t).alias("prose"), T.sentences(t).alias("sentences"), V.sections(t, F.lit(2)).alias("sections"),
                      V.near_duplicate_ratio(V.content_sets(T.sentences(t))).alias("near"))
    for r in rows.collect():
        assert K.tokens(r.text) == r.tokens and K.strip_noise(r.text) == r.noise and "\n".join(K.prose_lines(r.text.splitlines())) == r.prose
        assert K.sentences(r.text) == r.sentences and K.sections(r.text, 2) == [tuple(s) for s in r.sections]
        assert K.near_duplicate_ratio([s for s in (set(K.tokens(x)) - K.STOP for x in r.sentences) if len(s) >= 4]) == r.near


def test_page_metrics_reads_a_page_once(spark):
    text = plan(catalog.QUERIES["page_metrics"](spark, SF))
    assert text.count("MapInArrow") == 1 and "lambda" not in text
    none = V.metrics(spark.createDataFrame([("a", None, None, 0)], "path string, text string, body string, frontmatter_lines int")).first()
    assert none.line_count is None and none.max_sentence_words == 0 and none.repeated_5gram_ratio is None and none.avg_sentence_words == 0  # as SQL has it


def test_verbosity_audit_measures_a_page_once(spark):
    text = plan(catalog.QUERIES["verbosity_audit"](spark, SF))
    assert "regexp_extract_all" not in text and "MapInArrow" not in text  # it reads the judged rows that were written


def test_long_runs_take_no_longer_than_prose():
    """Pages of 30,000 characters in which a pattern could read what follows again from each place."""
    n = 30_000
    odd = ["a" + "\n" * n + "x", "\r" * n + "x", "\x85" + " \n" * (n // 2) + "x", "# a" + " " * n + "x", " " * n + "-", "[" * n, "[[a" * (n // 3), "[a](" * (n // 4), "![" * (n // 2), "[[" * (n // 2) + "|]]",
           "# " + " ".join(f"w{i}" for i in range(n // 6))]
    for page in odd:
        began = time.process_time()
        K.metrics(page, page, 0, 30, False)
        assert time.process_time() - began < 0.5, page[:9]


def test_links_are_those_of_the_patterns():
    r = random.Random(5)
    marks = (("![", 0, False, 1), ("[[", 1, True, 2), ("[", 1, False, 3))
    for _ in range(20_000):
        page = "".join(r.choice("[[]](()!|a\n") for _ in range(r.choice([4, 12, 40])))
        for mark, least, named, rule in marks:
            found = [(m.start(), m[1] if rule > 1 else None, m.end()) for m in re.finditer(T.NOISE[rule][0], page)]
            assert [(a, page[b:c] if rule > 1 else None, d) for a, b, c, d in K.brackets(page, mark, least, named)] == found, page
        assert [page[a:d] for a, _, _, d in K.brackets(page, "[[")] == re.findall(T.WIKILINK, page) and [page[a:d] for a, _, _, d in K.brackets(page, "[")] == re.findall(T.LINK, page)


@pytest.mark.parametrize("name", ["verbosity_rules", "verbosity_full"])
def test_rules_measure_a_page_once(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert text.count("MapInArrow") == 1 and "regexp_extract_all" not in text


def test_semantic_structure_in_tiles(spark, monkeypatch):
    """Pages of several tiles against all pairs; no expression holds a whole page."""
    r = random.Random(1)
    pages = {p: [[r.gauss(0, 1) for _ in range(5)] for _ in range(n)] for p, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10), ("e", 4))}
    pages["e"][1] = [0.0] * 5
    monkeypatch.setattr(semantic, "TILE", 3)
    frame = semantic.structure(spark.createDataFrame([(p, i, v) for p, vs in pages.items() for i, v in enumerate(vs)], "path string, ordinal int, vector array<double>"))
    assert "lambda" not in plan(frame)
    got = {x.path: x for x in frame.collect()}
    assert got.keys() == pages.keys()
    for p, vs in pages.items():
        unit = [np.array(v) / (np.linalg.norm(v) or 1.0) for v in vs]
        near = [max(0.0, min(1.0, a @ b)) for a, b in zip(unit, unit[1:])]
        most = [max(0.0, min(1.0, unit[i] @ unit[j])) for i in range(len(vs)) for j in range(i)]
        x = got[p]
        assert (x.section_count, x.adjacent_pairs, x.pairwise_pairs) == (len(vs), len(near), len(most))
        assert (x.coherence_score, x.semantic_redundancy_score) == ((pytest.approx(np.mean(near), abs=1e-6), pytest.approx(max(most), abs=1e-6)) if most else (None, None))


@pytest.mark.parametrize("name", ["section_spans", "section_replace"])
def test_sections_fold_no_page(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert text.count("MapInArrow") == 1 and "array_append" not in text


def test_sections_of_a_long_page(spark):
    """Time in proportion to the sections; the fence of four holds one of three."""
    n = 20_000
    body = "# Top\n````\n## no\n```\n````\n" + "\n".join(f"## S{i % 7} ##\ntext\n" for i in range(n))
    rows = sections.spans(spark.createDataFrame([("a", body), ("b", None), ("c", "---\n# x\n---\n### y")], "path string, text string")).collect()
    assert len(rows) == n + 2 and tuple(rows[0]) == ("a", "Top", 1, 1, len(body.splitlines()), 1) and tuple(rows[8]) == ("a", "S0", 2, 27, 29, 2)
    assert tuple(rows[-1]) == ("c", "y", 3, 4, 4, 1)


def test_hash_encoder_keeps_little(monkeypatch):
    """As many digests as are allowed, whatever the texts, and the same vectors as its features give."""
    monkeypatch.setattr(embed, "KEPT", 50)
    encode = embed.hash_encoder(64)
    texts = [" ".join(f"w{i * 7919 % 1000} Kx{j}" for j in range(20)) for i in range(60)] + ["", "one"]
    got = encode(texts)
    for row, t in zip(got, texts):
        want = np.zeros(64)
        for f in embed.features(t):
            v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
            want[v % 64] += 1.0 if v >> 8 & 1 else -1.0
        assert np.allclose(row, want / (np.linalg.norm(want) or 1.0))
    kept = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__)))
    assert 0 < len(kept["of_token"]) <= 50 and 0 < len(kept["of_pair"]) <= 50 and len(kept["of_token"].trigrams) <= 50


@pytest.mark.parametrize("name", ["score_normalize", "candidate_counts", "bm25_indexed", "search_indexed", "index_status", "search_explain"])
def test_search_tokenises_at_most_once(spark, name):
    """Texts are tokenised before the plan begins, once for a query; the plan reads counts."""
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "regexp_extract_all" not in text and "MapInArrow" not in text


def test_scaled_scores_read_a_text_once(spark):
    """However often statistics, scores and their ends are asked for."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(str(i), f"c/{i}.md", f"P {i}", "H", "concept", ["en"], None, "the of " * (i % 4) + "x y z", i % 5 == 4, 1, 1) for i in range(40)]
    schema = "id string, path string, title string, heading string, type string, tags array<string>, confidence string, text string, is_raw boolean, start_line int, end_line int"
    chunks = spark.createDataFrame(rows, schema).repartition(3).withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    got = search.min_max(search.bm25(chunks, "of the of"), "bm25", "scaled").collect()
    assert read.value == 40 and len(got) == 30 and {min(x.scaled for x in got), max(x.scaled for x in got)} == {0.0, 1.0}
