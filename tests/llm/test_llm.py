"""The ten operators: against SQL, brute force or exact round trips, and their defined cases."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from compare import SF, assert_same

from leafmill.llm import chat_format, exact_dedup, lm_scoring, minhash, mixing, packing, quality_classifier, quality_rules, queries, toxicity, warc
from leafmill.llm.common import input_table

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew a very strange potion near the old stone bridge at dusk every day of the long summer".split()
ODD = [
    (1, None, None, None), (2, "", "s", "en"), (2, "", "s", "en"), (None, "lone words here", "s", None), (3, " \n\t ", None, "en"),
    (4, " ".join(PROSE), "s", "en"), (5, " ".join(PROSE), "t", "en"), (5, " ".join(PROSE), "t", "en"), (6, " ".join([*PROSE, "end"]), "t", "de"),
    (7, "word " * 30_000, "t", "en"), (8, "x" * 200_000, "u", "en"), (9, "é ü 漢字   nb", "u", "fr"),
]
DOCS = "doc_id long, text string, source string, lang string, score double, kept string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with the names of results."""
    return spark.createDataFrame([(*r, 1.0, "x", "y") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 1), (6, 0, None), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])


def _shingles(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_minhash_against_all_pairs(spark):
    rows = input_table(spark, SF, "documents").select("doc_id", "text").collect()
    sets = {r.doc_id: _shingles(r.text) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if not x or not y:
            continue
        keys = sorted(set(x) | set(y))
        both = len(x.keys() & y.keys()) / len(keys)
        if both > 0.5:
            number = {k: i for i, k in enumerate(keys)}
            at = lambda c: (np.array([number[k] for k in sorted(c)], np.uint64), np.array([c[k] for k in sorted(c)]))
            if max(minhash.similarity(*at(x), *at(y))) >= 0.8:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    want = {k: find(k) for k in sets}
    assert {r.doc_id: r.class_id for r in minhash.classes(input_table(spark, SF, "documents")).collect()} == want


def test_probability_jaccard_by_definition():
    rng = np.random.default_rng(1)
    a, b = {k: int(rng.integers(1, 5)) for k in range(12)}, {k: int(rng.integers(1, 5)) for k in range(5, 17)}
    w = lambda c, k: float(minhash.weights(np.array(c[k]))) if k in c else 0.0
    want = sum(1 / sum(max(w(a, e) / w(a, d), w(b, e) / w(b, d)) for e in range(17)) for d in a if d in b)
    at = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
    assert minhash.similarity(*at(a), *at(b))[1] == pytest.approx(want)


def test_registers_estimate_probability_jaccard():
    ha, hb = np.arange(1, 101, dtype=np.uint64), np.arange(21, 121, dtype=np.uint64)
    h, rows = np.concatenate([ha, hb]), np.repeat([0, 1], 100)
    r = minhash.registers(minhash.sh.mix(h), rows, np.ones(200), 2, 4096)
    assert (r[0] == r[1]).mean() == pytest.approx(80 / 120, abs=0.04)


def test_minhash_links_sets_with_repeated_passages(spark):
    """Copies with a passage 20 times: their sets are alike, their weights are not. Each stands between
    two other copies, so that it is neither end of their buckets."""
    rng = np.random.default_rng(5)
    rows = []
    for base in range(15):
        words = [f"w{x}" for x in rng.integers(0, 100000, 450)]
        rows += [(3 * base, " ".join(["x", *words[1:]])), (3 * base + 1, " ".join(words + words[-150:] * 19)), (3 * base + 2, " ".join(["y", *words[1:]]))]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: d // 3 * 3 for d, _ in rows}


def test_minhash_finds_equal_sets_at_any_counts():
    """However counts differ, sets with a Jaccard similarity of 0.8 have a probability Jaccard of 0.78."""
    rng, least = np.random.default_rng(2), 1.0
    for _ in range(300):
        ha, hb = np.arange(180, dtype=np.uint64), np.arange(20, 200, dtype=np.uint64)
        na, nb = (np.where(rng.random(180) < rng.random(), 10**6, 1) for _ in range(2))
        plain, weighted = minhash.similarity(ha, na, hb, nb)
        least = min(least, weighted)
        assert plain == pytest.approx(0.8)
    assert 0.775 < least < 0.8


def test_minhash_links_a_passage_repeated_a_thousand_times(spark):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 100000, 204)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[100:] * 1000)), (3, " ".join(f"v{x}" for x in range(300)))]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_minhash_doc_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b), (12, c), (12, ""), (13, c + " more"), (14, ""), (15, "z " * 40)]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(3, 3), (5, 3), (5, 3), (9, 3), (9, 3), (12, 12), (12, 12), (13, 12), (14, 14), (15, 15)]


def test_minhash_odd(odd, none):
    got = {r.doc_id: r.class_id for r in minhash.classes(odd).collect()}
    assert got == {1: 1, 2: 2, None: None, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}
    assert minhash.keep_one(odd).columns == odd.columns and minhash.classes(none).count() == 0


def test_mixing_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and mixing.mix(none).count() == 0
    assert all(r.taken <= 3 * r["size"] for r in got) and {r.taken for r in got if r["size"] == 0} == {0}
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.taken)
    total = sum(r["size"] for r in got)
    assert all(abs(sum(v) - target) <= 0.001 * total + 10 for (_, target), v in by.items())
    assert mixing.apply_mix(odd).columns == odd.columns


def test_packing_round_trip(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = packing.pack(odd, keep_ids=True).collect()
    want = Counter()
    for doc, text, *_ in ODD:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[doc, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(none).count() == 0


def test_token_ids_of_every_letter():
    """Every assigned letter and mark alone, in both cases, before and after punctuation, marks, digits and letters."""
    import sys
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm.tokens import WordTokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok, own = Tokenizer.from_file(path), WordTokenizer(path)
    signs = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LM" and not "\u4e00" < c < "\u9fff" and not "\uac00" < c < "\ud7a3" and c < "\U00013000"]
    texts = [" ".join((c, f"{c},", f"{c.upper()}!?", f"a{c}b.", f"{c}\u0301-", f"({c}", f"{c}1", f"{c}'s", f"A{c}")) for c in signs]
    texts += ["\u0915\u093c,", "I\u0307,", "<|endoftext|> a<|endoftext|>b <|startoftext|>,", "\u03a3\u0391\u03a3. \u039f\u0394\u039f\u03a3", "don't DON'T'S 've'll", "a\u00a0b\tc\x0bd\u2028e", "x_y __ -- 3.14", ""]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert [t for t, x, y in zip(texts, got, want) if x != y] == []


def test_packing_by_classes_is_best_fit():
    rng = np.random.default_rng(4)
    for top in (3, 40, 500, 1000):
        sizes = rng.integers(1, top, 3000).tolist()
        counts = Counter(sizes)
        runs, bins = packing.fit_classes(list(counts), list(counts.values()), 1000)
        assert len(packing.best_fit(sizes, 1000)[2]) == sum(n for _, n, _ in bins)
        spans, ranks = {}, {}
        for size, rank, n, first, at in runs:
            ranks.setdefault(size, []).append((rank, rank + n))
            for b in range(first, first + n):
                spans.setdefault(b, []).append((at, at + size))
        fills = {b: f for first, n, f in bins for b in range(first, first + n)}
        for b, own in spans.items():
            own.sort()
            assert [x for x, _ in own] == [0, *[y for _, y in own[:-1]]] and own[-1][1] == fills[b] <= 1000
        for size, own in ranks.items():
            own.sort()
            assert [x for x, _ in own] == [0, *[y for _, y in own[:-1]]] and own[-1][1] == counts[size]


@pytest.mark.parametrize("parts", [1, 9, 90])
def test_packing_reaches_the_bound(spark, parts):
    """Nearly as few sequences as best-fit needs for all pieces at once: partitions of 11 documents cost 4 %."""
    docs = input_table(spark, SF.replace("0.001", "0.01"), "documents").repartition(parts)
    rows = packing.pack(docs).collect()
    whole = len(packing.best_fit([r.length for r in rows], 2048)[2])
    bound = -(-sum(r.length for r in rows) // 2048)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    assert bound <= len(places) <= {1: 1.0, 9: 1.015, 90: 1.04}[parts] * whole + 1


def test_warc_odd(spark, tmp_path):
    big = "<p>é</p>" * 400
    pages = [(1, "http://a/x y", big), (2, None, big), (3, "http://b/", None), (None, "http://c/", "tiny"), (4, "::bad[", big), (5, "http://d", "tiny")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.digests(warc.captures(spark, str(tmp_path / "w"))).collect()}
    for page, _, html in pages:
        body = (html or "").encode()
        stored = 4 if len(body) >= 1000 else None
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", stored) if stored and page != stored else ("response", None))
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.captures(spark, str(tmp_path / "e")).count() == 0


def test_warc_files_roll_by_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    pages = [(k, "http://a/", rng.bytes(4000).hex()) for k in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in pages], "page_id long, url string, html string, payload string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), file_bytes=50_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 8 and max(sizes) < 60_000
    assert {r.page_id: r.payload_digest for r in warc.digests(warc.captures(spark, str(tmp_path / "w"))).collect()} == {k: hashlib.sha1(h.encode()).hexdigest() for k, _, h in pages}


def test_warc_repeated_rows(spark, tmp_path):
    big = "<p>x</p>" * 300
    df = spark.createDataFrame([(1, "http://a/", big), (1, "http://a/", big), (0, "http://b/", big), (2, None, None)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.digests(warc.captures(spark, str(tmp_path / "w"))).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None)]


def test_lm_scoring_by_definition(spark):
    texts = [(1, "a b a b c", True), (2, "a b d", False), (3, "c c c", None), (4, None, True)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, target boolean")
    got = {r.doc_id: r for r in lm_scoring.score(rows).collect()}
    words = {d: (t or "").split() for d, t, _ in texts}
    size = len({w for ws in words.values() for w in ws})

    def model(docs, without):
        uni, bi = Counter(), Counter()
        for d in docs:
            if d != without:
                uni.update(words[d])
                uni["<s>"] += bool(words[d])
                bi.update(zip(["<s>", *words[d]], words[d]))
        return uni, bi

    def loss(docs, doc, scale):
        uni, bi = model(docs, doc)
        n = sum(v for k, v in uni.items() if k != "<s>") * scale
        out = []
        for b, w in zip(["<s>", *words[doc]], words[doc]):
            single = (uni[w] * scale + lm_scoring.EVEN) / (n + lm_scoring.EVEN * size)
            out.append(-np.log((bi[b, w] * scale + lm_scoring.BACK_OFF * single) / (uni[b] * scale + lm_scoring.BACK_OFF)))
        return float(np.mean(out))

    for d in (1, 2, 3):
        assert got[d].target_loss == pytest.approx(loss([1, 4], d, 1.0), rel=1e-5)
        assert got[d].background_loss == pytest.approx(loss([1, 2, 3, 4], d, 5 / 11), rel=1e-5)
    assert got[4].score is None and got[4].n_words == 0


def test_lm_scoring_keeps_every_word_and_pair(spark, monkeypatch):
    """More distinct words than any fixed table of 2^18 cells holds; each stands once."""
    monkeypatch.setattr(lm_scoring, "BUCKET_TEXT", 1 << 19)
    n, each = 300, 1000
    texts = spark.range(n, numPartitions=3).selectExpr("id AS doc_id", f"array_join(transform(sequence(0, {each - 1}), i -> concat('w', id * {each} + i)), ' ') AS text", "id = 0 AS target")
    even, size = lm_scoring.EVEN, n * each
    scale = each / size
    target = -np.log(even / (each + even * size))
    background = -np.log(even / ((size - each) * scale + even * size))
    for r in lm_scoring.score(texts).where("doc_id != 0").collect():
        start_t, start_b = np.log(1 + 1 / lm_scoring.BACK_OFF) / each, np.log(1 + (n - 1) * scale / lm_scoring.BACK_OFF) / each
        assert r.target_loss == pytest.approx(target + start_t, rel=1e-9)
        assert r.background_loss == pytest.approx(background + start_b, rel=1e-9)


def test_lm_scoring_odd(odd, none, labels):
    rows = lm_scoring.with_target(odd, labels)
    assert lm_scoring.score(rows).count() == len(ODD)
    assert lm_scoring.score(lm_scoring.with_target(none, labels)).count() == 0
    assert {r.score for r in lm_scoring.score(rows.where("NOT target")).collect()} == {0.0, None}


def test_exact_dedup_odd(odd, none):
    got = exact_dedup.annotate(odd).collect()
    groups = {}
    for d, t, *_ in ODD:
        groups.setdefault(t or "", []).append(d)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.keep_first(odd).columns == odd.columns and exact_dedup.annotate(none).count() == 0


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact_dedup_leaves_the_callers_columns(spark, odd, monkeypatch):
    """Columns with the names of results or of anything else come back as they were, with any join."""
    from pyspark.sql import functions as F

    names = ("kept", "ties", "twins", "keep_id", "group_size", "text_sha256", "__kept", "__c0", "a.b")
    df = odd.drop("kept").select("*", *[F.concat(F.lit(f"{x}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(x) for x in names])
    rows = [tuple(r) for r in df.collect()]
    at = df.columns.index("text")
    want = Counter({max((r for r in rows if (r[at] or "") == t), key=lambda r: (r[0] is not None, r[0] or 0)): 1 for t in {r[at] or "" for r in rows}})
    assert _rows(exact_dedup.keep_first(df)) == want
    monkeypatch.setattr("leafmill.llm.common.BROADCAST_BYTES", 0)
    assert _rows(exact_dedup.keep_first(df)) == want and sum(r.kept for r in exact_dedup.annotate(df).collect()) == len(want)


@pytest.mark.parametrize("name", ["op2_mixing", "op4_warc", "op6_exact_dedup", "op7_chat_format", "op10_quality_rules"])
def test_matches_sql_without_broadcasts(spark, name, monkeypatch):
    monkeypatch.setattr("leafmill.llm.common.BROADCAST_BYTES", 0)
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])


def test_exact_dedup_shuffles_no_texts_for_verdicts(spark, monkeypatch):
    """With verdicts too many for a broadcast, the query's last join carries hashes and numbers only."""
    monkeypatch.setattr("leafmill.llm.common.BROADCAST_BYTES", 0)
    plan = queries.op6_exact_dedup(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[: plan.index("Relation")]
    assert "Join LeftOuter" in join and "text#" not in join.split("Join LeftOuter")[0]


def test_exact_dedup_by_bytes_under_colliding_fingerprints(odd):
    from pyspark.sql import functions as F

    got = exact_dedup.annotate(odd, lambda c: F.lit(1).cast("long") + 0 * F.length(c)).collect()
    assert sum(r.kept for r in got) == len({r[1] or "" for r in ODD})


def _dialogue(rows, me):
    """The rendering of one conversation by definition: text and spans."""
    clean = lambda t: (t or "").replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    own = sorted(((k is not None, k or 0, r or "unknown", clean(t)) for k, r, t in rows))
    names = {}
    for r in sorted({r for _, _, r, _ in own}):
        base = "".join(c if c.isalnum() or c in "_-" else "_" for c in r)
        same = sum(n.split("#")[0] == base for n in names.values())
        names[r] = f"{base}#{same + 1}" if same else base
    text, spans = "", []
    for _, _, r, t in own:
        head = "assistant" if r == me else "system" if r == "system" else f"user name={names[r]}"
        text += f"<|im_start|>{head}\n"
        if r == me:
            spans.append((len(text), len(text) + len(t) + 10))
        text += f"{t}<|im_end|>\n"
    return text, spans


@pytest.mark.parametrize("settings", [{}, {"piece_turns": 10, "shift": 2}])
def test_chat_by_definition(spark, settings):
    """Ties, nulls, names that fall together and a conversation above PIECE_TURNS, whole or in pieces."""
    roles = ("ann", "a b", "a_b", "a_b-2", "system", None)
    rows = [(c, k % 5 if c else k, roles[k % 6], f"t{k % 9} <|im_end|>" if k % 7 else None) for c in (0, 1, None) for k in range(48)]
    rows += [(2, None if k == 3 else k // 3, roles[k % 5], f"t{k * 7 % 11}") for k in range(1200)] + [(3, 0, "system", "only")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, name string").repartition(3)
    parts = {}
    for r in chat_format.rotate(df, **settings).collect():
        parts.setdefault((r.conv_id, r.participant), []).append(r)
    people = {(c, r or "unknown") for c, _, r, _ in rows if r != "system"}
    assert parts.keys() == people and all(len(p) > 1 for (c, _), p in parts.items() if c == 2 or settings)
    for (c, me), p in parts.items():
        p.sort(key=lambda r: r.piece)
        own = [(k, r, t) for x, k, r, t in rows if x == c]
        text, spans = _dialogue(own, me)
        assert [r.piece for r in p] == list(range(len(p))) and sum(r.n_turns for r in p) == len(own)
        assert "".join(r.text for r in p) == text and [tuple(s) for r in p for s in r.spans] == spans
        assert [r.start for r in p] == [0, *np.cumsum([len(r.text) for r in p])[:-1]] and sum(r.masked_chars for r in p) == sum(y - x for x, y in spans)
    assert chat_format.rotate(df.where("false")).count() == 0 and chat_format.rotate(df.where("role = 'system'")).count() == 0


def test_quality_classifier_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op8_quality_classifier(spark, sf).join(input_table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.97


def _quality_by_definition(docs, labels, held):
    """Co-training row by row, with dictionaries for the cells."""
    q, mix = quality_classifier, quality_classifier.sh.mix
    number = lambda x: np.array([x], np.uint64)

    def row(text, source, lang):
        data, w = (text or "").encode(), (text or "").encode().split()
        cells = Counter(int(mix(number(data[i] << 16 | data[i + 1] << 8 | data[i + 2]))[0] % (q.TEXT_CELLS - 1)) for i in range(len(data) - 2))
        if n := sum(a == b for a, b in zip(w, w[1:])):
            cells[q.TEXT_CELLS - 1] = q.AGAIN * n
        total = max(1, sum(cells.values()))
        kinds = np.bincount([q._CLASS[x] for x in data], minlength=5)[None, :] if data else np.zeros((1, 5), int)
        meta = q.meta_cells(np.array([len(data)]), np.array([len(w)]), np.array([data.count(b"\n") + 1]), kinds, [source], [lang])[0].tolist()
        return {c: v / total for c, v in cells.items()}, Counter(meta), np.log1p(len(data)) / 10

    rows = {d: row(*x) for d, *x in docs}
    learn = {d: y for d, y in labels.items() if y is not None and d not in held}
    spare = {d for d in learn if held[None](d)}

    def odds(view, marks):
        out = {}
        mass = [Counter(), Counter()]
        for d, (y, weight) in marks.items():
            for c, v in rows[d][view].items():
                mass[y][c] += v * weight
        width = (q.TEXT_CELLS, q.META_CELLS)[view]
        scale = [sum(m.values()) for m in mass]
        p = lambda y, c: np.log((mass[y][c] + q.SMOOTH * scale[y] / (scale[y] + width)) / (scale[y] * (1 + q.SMOOTH)))
        for c in {*mass[0], *mass[1], *(c for d in rows for c in rows[d][view])}:
            out[c] = float(np.clip(p(1, c) - p(0, c), -6, 6))
        return out

    def raw(view, o, d):
        cells = rows[d][view]
        return [1.0, sum(o[c] * v for c, v in cells.items()) * (10 if view == 0 else 1), rows[d][2]]

    base = {d: (y, 1.0) for d, y in learn.items() if d not in spare}
    marks = [dict(base), dict(base)]
    order = sorted(spare)
    y = np.array([learn[d] for d in order], float)
    for turn in range(q.ROUNDS + 1):
        logits, coefs = {}, []
        for view in (0, 1):
            o = odds(view, marks[view])
            coef = q.regression(np.array([raw(view, o, d) for d in order]), y)
            logits[view] = {d: float(np.clip(np.dot(raw(view, o, d), coef), -12, 12)) for d in rows}
        if turn == q.ROUNDS:
            break
        for me, other in ((0, 1), (1, 0)):
            sure = {d: int(p >= q.SURE) for d in rows if d not in learn and not 1 - q.SURE < (p := q.sigmoid(logits[me][d])) < q.SURE}
            marks[other] = dict(base)
            for label in (0, 1):
                mine = sum(v for d, (l, _) in base.items() if l == label for v in rows[d][other].values())
                new = sum(v for d, l in sure.items() if l == label for v in rows[d][other].values())
                weight = min(1.0, mine / new) if new else 1.0
                marks[other] |= {d: (label, weight) for d, l in sure.items() if l == label}
    coef = q.regression(np.array([[1.0, logits[0][d], logits[1][d]] for d in order]), y)
    return {d: float(q.sigmoid(coef[0] + coef[1] * logits[0][d] + coef[2] * logits[1][d])) for d in rows}


def test_quality_classifier_by_definition(spark):
    rng = np.random.default_rng(9)
    good, bad = PROSE, "CLICK here now!!! $$$ win 100% free 999 prize".split()
    docs = []
    for d in range(160):
        words = list(rng.choice(good if d % 2 else bad, int(rng.integers(5, 60)))) + list(rng.choice(good + bad, 10))
        docs.append((d, ("\n" if d % 3 else " ").join(words), f"s{(d + d // 7) % 2 + d % 3 * 2}", "en" if d % 5 else None))
    docs += [(160, None, "s1", "en"), (161, "", None, None), (162, "ab", "s0", "de"), (163, "é" * 5000, "s3", "fr")]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, source string, lang string, quality string").repartition(3)
    labels = spark.createDataFrame([(d, d % 2) for d in range(0, 100)], "doc_id long, quality int")
    picked = {r.doc_id: r.spare for r in quality_classifier.sample(df, labels).collect()}
    held = {d for d in range(100) if zlib.crc32(str(d).encode()) % 4 == 2}
    assert picked.keys() == set(range(100)) - held
    want = _quality_by_definition(docs, {d: d % 2 for d in range(100)}, {**dict.fromkeys(held), None: lambda d: picked[d]})
    got = {r.doc_id: r.score for r in quality_classifier.score(df, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-3
    assert np.mean([(got[d] >= 0.5) == (d % 2 == 1) for d in range(160)]) > 0.9


def test_quality_classifier_odd(odd, none, labels):
    assert quality_classifier.score(odd, labels).count() == len(ODD) and quality_classifier.score(none, labels).count() == 0
    assert {r.score for r in quality_classifier.score(odd, labels.where("false")).collect()} == {0.5}


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op9_toxicity(spark, sf).join(input_table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    hit, said = (got.predicted == 1) & (got.toxic == 1), got.predicted == 1
    assert hit.sum() / max(1, (got.toxic == 1).sum()) > 0.8 and hit.sum() / max(1, said.sum()) > 0.8


def test_toxicity_odd(odd, none, labels):
    got = toxicity.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, labels).count() == 0
    assert toxicity.keep_clean(odd, labels.where("false")).columns == odd.columns


def _distance(a, b):
    """Edits with neighbours that change places, by dynamic programming."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_levenshtein_automaton_against_dynamic_programming():
    from leafmill.llm.levenshtein import Automaton

    rng = np.random.default_rng(3)
    for _ in range(500):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(2))
        auto = Automaton(a, 2)
        state = auto.start
        for c in b:
            state = auto.step(state, c)
        d = _distance(a, b)
        assert auto.edits(state) == (d if d <= 2 else None)


def test_lexicon_against_every_term():
    from leafmill.llm.levenshtein import Lexicon

    rng = np.random.default_rng(7)
    word = lambda n, m: "".join(rng.choice(list("abc"), rng.integers(n, m)))
    terms = {word(2, 9) + "*" * int(rng.integers(0, 2)): 0 for _ in range(25)}
    terms = {t: int(len(t.rstrip("*")) >= 4) for t in terms}
    lexicon = Lexicon(terms)
    for _ in range(800):
        w = word(1, 11)
        want = {}
        for t, k in terms.items():
            ends = range(len(w) + 1) if t.endswith("*") else [len(w)]
            if (d := min(_distance(w[:e], t.rstrip("*")) for e in ends)) <= k:
                want[t] = d
        assert dict(lexicon.search(w)) == want and (lexicon.possible(w) or not want)


def _toxic_rows(n=400):
    """Two words and a family of words mark toxic texts; the rest is drawn from one vocabulary."""
    rng = np.random.default_rng(8)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ras", "ten", "vol", "dim") for c in ("a", "e", "or", "ist")]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        if i % 4 == 0:
            for w in rng.choice(["grobiate", "snorfel", "blafkertig", "blafkerung", "blafkeron", "blafkerix", "blafkerus"], 3):
                words.insert(int(rng.integers(0, 60)), w)
        rows.append((i, " ".join(words), 0, int(i % 4 == 0)))
    return rows, plain


def test_toxicity_finds_planted_misspellings(spark):
    rows, plain = _toxic_rows()
    n, base = len(rows), " ".join(plain)
    bad = ["grobaite", "grobiat", "gorbiate", "grobixate", "snorfle", "snofrel", "blafketrig and blakferung", "blafkxrung blafekron"]
    planted = [(10000 + 4 * i, f"{base} {w} {w} {base}", 1) for i, w in enumerate(bad)] + [(20000, base, 0), (20001, f"{base} grobia snor blaf", 0), (20002, None, 0), (20003, "", 0)]
    docs = spark.createDataFrame([(d, t) for d, t, *_ in rows] + [(d, t) for d, t, _ in planted], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    assert len(got) == n + len(planted) and {d: got[d] for d, _, y in planted} == {d: y for d, _, y in planted}
    truth = [(got[d], y) for d, _, _, y in rows]
    assert sum(x == y for x, y in truth) >= 0.98 * n


def test_toxicity_context_by_definition():
    model = toxicity.Model({"snorfel": 4.0}, [], toxicity._DEFAULT)
    quoted = lambda t: [q for *_, q, _ in model.hits(t)]
    far = "x " * 5000
    assert quoted(f'plain snorfel here') == [False] and quoted(f'a "{far}snorfel {far}" b') == [True]
    assert quoted(f'a "b" {far} snorfel {far} c') == [False] and quoted('a "b snorfel\n" c') == [False]
    assert quoted("> a snorfel\nsnorfel") == [True, False] and quoted("they called it snorfel") == [True]
    assert [y for *_, y in model.hits("you snorfel")] == [True]


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    rows, _ = _toxic_rows(80)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    docs = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels).collect()
    sizes = Counter()
    for r in got:
        sizes[r.toxic] += len(r.text)
    assert set(sizes) == {0, 1} and all(2000 < v <= 3000 for v in sizes.values())


def test_quality_rules_odd(odd, none):
    got = quality_rules.judge(odd).collect()
    assert len(got) == len(ODD) and quality_rules.judge(none).count() == 0
    assert all(r.base_failed for r in got if r.n_words < 50) and not any(r.kept and r.base_failed for r in got)


def test_quality_rules_host_verdicts(spark):
    """A large host of bad pages goes whole, with its good pages; a tiny bad host and clean hosts stay; a
    null host is a host of its own."""
    good = " ".join(f"word{i}" for i in range(60))
    rows, bad = [], "buy now " * 60
    rows += [(i, "bad", bad if i % 3 else good) for i in range(200)]
    rows += [(1000 + i, f"clean{i % 4}", good if i % 50 else bad) for i in range(800)]
    rows += [(3000, "tiny", bad), (3001, "tiny", good)] + [(4000 + i, None, good + " a|b $$ #c |% <>") for i in range(100)]
    df = spark.createDataFrame([(*r, True, "x") for r in rows], "doc_id long, source string, text string, kept boolean, host string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert {r.host for r in got.values() if r.host_rejected} == {"bad", None}
    for d, host, text in rows:
        assert got[d].base_failed == (text == bad) and got[d].kept == (host not in ("bad", None) and text != bad)


def _near_copies(texts):
    """doc_ids that all pairs find to be near copies of a lesser one, transitively."""
    sets, root = {d: _shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x.keys() & y.keys()) / len(x.keys() | y.keys()) > 0.5:
            number = {k: i for i, k in enumerate(sorted(x.keys() | y.keys()))}
            at = lambda c: (np.array([number[k] for k in sorted(c)], np.uint64), np.array([c[k] for k in sorted(c)]))
            if max(minhash.similarity(*at(x), *at(y))) >= 0.8:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d for d in texts if find(d) != d}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, recomputed without Spark."""
    import corpus_pipeline
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    table = input_table(spark, SF, "documents")
    model = toxicity.fit(table, input_table(spark, SF, "labels"))
    docs = {r.doc_id: r for r in table.collect()}
    docs = {d: r for d, r in docs.items() if model.score(r.text) < toxicity.THRESHOLD}
    last = {}
    for d in sorted(docs):
        last[docs[d].text or ""] = d
    docs = {d: docs[d] for d in last.values()}
    near = _near_copies({d: r.text for d, r in docs.items()})
    docs = {d: r for d, r in docs.items() if d not in near}
    con = duckdb.connect()
    rows = [tuple(r) for r in docs.values()]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(dict(zip(table.columns, r))[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows])
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({queries.OP2_SQL})").fetchall()
    copies = {d: 1 if n == 0 else int(t / n + 0.5) for d, n, t in taken}
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for d, n in copies.items():
        ids = tok.encode(docs[d].text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[d, k // 2048, k, len(part) // 4, zlib.crc32(part)] += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048 and len(fills) <= 1.05 * -(-sum(fills.values()) // 2048) + 1


def test_pipeline_odd(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.where("false").write.parquet(str(tmp_path / name / "labels.parquet"))
        table, at = input_table(spark, str(tmp_path / name), "documents"), str(tmp_path / name)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, at)
            assert table.columns == docs.columns
        left = {r.doc_id for r in corpus_pipeline.run(spark, at).collect()}
        assert left <= {r[0] for r in ODD} and (bool(left) == (name == "odd"))
