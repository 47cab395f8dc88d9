"""Kernels that SQL can't express, against plain Python."""

import difflib
import gzip
import hashlib
import re

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import vectors as V
from leafmill.operators import chunks, embed, semantic
from leafmill.plans import catalog
from leafmill.sources import corpus
from leafmill.sources.tables import as_snapshots, table

TOKEN = re.compile(T.TOKEN)


def _texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_hash_embed(spark):
    def model(text):
        toks = [t.lower() for t in TOKEN.findall(text)]
        feats = [f"bi:{a} {b}" for a, b in zip(toks, toks[1:])]
        for t in toks:
            feats += [f"tok:{t}", *[f"tri:{('<' + t + '>')[i:i + 3]}" for i in range(len(t))]]
        out = np.zeros(256)
        for f in feats:
            v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
            out[v % 256] += 1.0 if v >> 8 & 1 else -1.0
        n = np.linalg.norm(out)
        return out / n if n else out

    texts = _texts(spark)
    for r in catalog.QUERIES["hash_embed"](spark, SF).collect():
        assert np.allclose(r.vector, model(texts[r.doc_id] or ""), atol=1e-6)


def test_gzip_ratio(spark):
    texts = _texts(spark)
    for r in catalog.QUERIES["gzip_ratio"](spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.gzip_ratio == pytest.approx(len(gzip.compress(raw, mtime=0)) / len(raw) if raw else 1.0, abs=1e-6)


def test_line_diff(spark):
    old, new = ({r.path: r.text for r in df.select("path", "text").collect()} for df in as_snapshots(table(spark, SF, "documents")))
    got = {r.path: r for r in catalog.QUERIES["line_diff"](spark, SF).collect()}
    assert got.keys() == {p for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    for p, r in got.items():
        a, b = old.get(p, "").splitlines(), new.get(p, "").splitlines()
        if r.kind == "modified":
            ops = [o for o in difflib.SequenceMatcher(a=a, b=b).get_opcodes() if o[0] != "equal"]
            assert (r.added_lines, r.removed_lines) == (sum(o[4] - o[3] for o in ops), sum(o[2] - o[1] for o in ops))
        else:
            assert (r.added_lines, r.removed_lines) == (len(b), len(a)) and r.kind == ("added" if p in new else "deleted")


def _pack(text, start, limit):
    runs, now, n = [], [], 0
    for no, line in enumerate(text.split("\n"), start):
        if not line.strip():
            continue
        k = len(TOKEN.findall(line))
        if now and n + k > limit:
            runs.append(now)
            now, n = [], 0
        now.append((no, line))
        n += k
        if n >= limit:
            runs.append(now)
            now, n = [], 0
    return [(r[0][0], r[-1][0], "\n".join(x for _, x in r).strip()) for r in [*runs, *([now] if now else [])]]


def test_pack_locators(spark):
    text = "## H\n\nalpha beta gamma delta\none two three\n\nfour five six seven eight nine ten\nx\n"
    rows = [("a", text.strip(), 12, 18), ("b", "short text", 1, 1), ("c", "\n".join(f"w{i} v{i}" for i in range(40)), 3, 42)]
    df = spark.createDataFrame([(i, "p.md", "", "t", "k", [], None, "", 2, t, False, "", a, b) for i, t, a, b in rows], "id string, path string, slug string, title string, type string, tags array<string>, confidence string, heading string, level int, text string, is_raw boolean, text_hash string, start_line int, end_line int")
    got = {}
    for r in chunks.locators(df, 8).orderBy("parent_id", "vector_ordinal").collect():
        got.setdefault(r.parent_id, []).append((r.id, r.start_line, r.end_line, r.text))
    assert got["b"] == [("b", 1, 1, "short text")]
    for i, t, a, _ in (rows[0], rows[2]):
        assert got[i] == [(f"{i}:v{k}", *run) for k, run in enumerate(_pack(t, a, 8))]
    assert [x[0] for x in catalog.QUERIES["pack_locators"](spark, SF).select("id").limit(3).collect()]


def test_verbosity_full(spark):
    """The page that repeats one sentence is flagged for it, and gzip has its rule."""
    rows = {r.path: r for r in catalog.QUERIES["verbosity_full"](spark, SF).collect()}
    texts = {f"doc-{d}.md": t for d, t in _texts(spark).items()}
    assert len(rows) == len(texts)
    for path, r in rows.items():
        codes = {x.code for x in r.reasons}
        words = TOKEN.findall(texts[path.split("/")[1]] or "")
        assert 0 <= r.score <= 1 and ("word_count_high" in codes) == (len(words) >= 3000)
        assert (r.severity == "ok") == (r.score < 0.35 and not codes)


def test_front_matter(spark):
    page = "---\ntitle: My Page\ntags: [a, 5]\ntype: concept\nconfidence: 0.5\nnested: {k: [1, 2]}\n---\n\n# Heading\n\nbody\n"
    rows = [("entities/x.md", page, 0), ("raw/y.md", "# Own title\ntext", 1), ("z/plain.md", "no heading", 2), ("a/b.md", "---\n- list\n---\nx", 3), ("a/c.md", "---\ntags: one\n---\n", 4), ("a/d.md", "---\nopen", 5)]
    got = {r.path: r for r in corpus.parse(spark.createDataFrame(rows, "path string, text string, size int")).collect()}
    x = got["entities/x.md"]
    assert (x.title, x.type, x.tags, x.confidence, x.body, x.frontmatter_lines) == ("My Page", "concept", ["a", "5"], "0.5", "# Heading\n\nbody\n", 8)
    assert '"nested": {"k": [1, 2]}' in x.frontmatter
    assert (got["raw/y.md"].title, got["raw/y.md"].type, got["raw/y.md"].is_raw) == ("Own title", "raw", True)
    assert (got["z/plain.md"].title, got["z/plain.md"].type, got["a/b.md"].title, got["a/b.md"].body) == ("plain", "page", "b", "x")
    assert got["a/c.md"].tags == ["one"] and got["a/d.md"].body == "---\nopen" and got["a/d.md"].frontmatter_lines == 0


def test_embedders(spark):
    states = np.array([[[3.0, 4.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 2.0]]])
    assert np.allclose(embed.mean_pool(states, np.array([[1, 0], [1, 1]])), [[0.6, 0.8], [0.0, 1.0]])
    seen = []

    def fixed(texts):
        seen.append(list(texts))
        return np.array([[len(t), 1.0] for t in texts])

    assert embed.batched(fixed, 2)(["a", "bb", "ccc"]).tolist() == [[1, 1], [2, 1], [3, 1]] and seen == [["a", "bb"], ["ccc", ""]]
    assert embed.create("Hash", dimensions=8).dimensions == 8
    with pytest.raises(ValueError):
        embed.create("other")


def test_models_of_readability(spark):
    pages = spark.createDataFrame([("a", "  one\n two  "), ("b", "x" * 50)], "path string, body string")
    got = {r.path: (r.predicted_label, r.predicted_score) for r in semantic.classify(pages, lambda: lambda texts: [(t, float(len(t))) for t in texts], max_chars=10).collect()}
    assert got == {"a": ("one two", 7.0), "b": ("x" * 10, 10.0)}
    rows = [("p", "g", 0, None, 0.2), ("p", "g", 1, "hard", 0.4), ("p", "h", 0, None, None)]
    frame = spark.createDataFrame(rows, f"path string, group string, order int, predicted_label string, {semantic.SCORES[0]} double")
    merged = {r.group: r for r in semantic.merge(frame).collect()}
    assert merged["g"].predicted_label == "hard" and merged["g"][semantic.SCORES[0]] == pytest.approx(0.3) and merged["h"][semantic.SCORES[0]] is None
    vec = spark.range(1).select(F.array(F.lit(1.0), F.lit(0.0)).alias("a"), F.array(F.lit(1.0), F.lit(1.0)).alias("b"))
    assert vec.select(semantic.preservation(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.707107) and vec.select(V.normalise(F.col("b"))).first()[0] == pytest.approx([0.5**0.5] * 2)
    assert spark.range(1).select(T.section_prose(F.lit("# A\n```\ncode\n```\nsee `x` [l](u)  end"))).first()[0].endswith("end")
