"""The verbs over a page tree: index, search, read, write, ledger, audit."""

import pytest
from leafmill.operators import audit, embed, index
from leafmill.operators import write as W
from leafmill.workspace import EmbeddingConfig, Workspace

PAGE = """# Alpha

Intro line about grapes.

## Growing grapes

Grapes need sun and a dry autumn.

## Pressing

Press the grapes gently.
"""


@pytest.fixture
def wiki(spark, tmp_path):
    for name, text in (("concepts/alpha.md", PAGE), ("entities/beta.md", "# Beta\n\nA barrel of oak.\n"), ("raw/notes.md", "# Notes\n\ngrapes raw\n"), ("root.md", "# Out\n"), ("concepts/.vector/x.md", "# No\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return Workspace(spark, str(tmp_path))


def test_scan_and_read(wiki):
    assert [r.path for r in wiki.files(True).orderBy("dir_rank", "path").collect()] == ["entities/beta.md", "concepts/alpha.md", "raw/notes.md"]
    assert wiki.read("concepts/alpha.md", heading="Pressing").first().content.startswith("## Pressing")
    assert wiki.read("concepts/alpha.md", start_line=5, end_line=5).first().content == "## Growing grapes"
    assert wiki.read("concepts/alpha.md").first().content == PAGE


def test_index_status_search(spark, wiki):
    assert wiki.status().first().pages_indexed == 0
    done = wiki.reindex().first()
    assert (done.pages_indexed, done.chunks_indexed, done.include_raw, done.embedding_model) == (2, 4, False, "hashing-ngram-256")
    best = wiki.search("pressing grapes").collect()
    assert best[0].path == "concepts/alpha.md" and best[0].heading == "Pressing" and all(not r.path.startswith("raw/") for r in best)
    assert wiki.search("$$$").count() == 0
    row = wiki.search_explain("pressing grapes").first()
    assert row.tokens == ["pressing", "grapes"] and row.candidates.chunks_total == 4 and [r.path for r in row.results][0] == "concepts/alpha.md"
    assert {k.term: k.matching_chunks for k in row.keywords} == {"pressing": 1, "grapes": 2}
    with pytest.raises(index.FingerprintError):
        index.Searcher(wiki.store, embed.hashing(64))
    wiki.reindex(include_raw=True)
    assert {r.path for r in wiki.search("grapes", include_raw=True).collect()} >= {"raw/notes.md"}
    assert "raw/notes.md" not in {r.path for r in wiki.search("grapes").collect()}


def test_write_modes(wiki, tmp_path):
    wiki.write("queries/new.md", "# New\n\nfirst  \n\n", reindex=False)
    with pytest.raises(FileExistsError):
        wiki.write("queries/new.md", "x", reindex=False)
    wiki.write("queries/new.md", "more", mode="append", reindex=False)
    assert (tmp_path / "queries/new.md").read_text() == "# New\n\nfirst\n\n\nmore\n"
    wiki.write("queries/new.md", "# Again", mode="overwrite", reindex=False)
    assert (tmp_path / "queries/new.md").read_text() == "# Again\n"
    got = wiki.write("concepts/alpha.md", "Press hard.", mode="replace-section", heading="Pressing", reindex=False)
    assert (got["start_line"], got["end_line"]) == (9, 11) and (tmp_path / "concepts/alpha.md").read_text().endswith("## Pressing\nPress hard.\n")
    for path in ("/abs.md", "../up.md", "a/b.txt", ".vector/x.md"):
        with pytest.raises(ValueError):
            wiki.write(path, "x")
    with pytest.raises(ValueError):
        wiki.write("a.md", "  \n")
    with pytest.raises(FileNotFoundError):
        wiki.write("concepts/none.md", "x", mode="replace-section", heading="A")
    assert not [p for p in tmp_path.rglob("*.md.*")]


def test_write_many(spark):
    pages = spark.createDataFrame([("a.md", "one\n"), ("b.md", "two\n\n"), ("c.md", "three\n")], "path string, text string")
    edits = spark.createDataFrame([("a.md", "append", "x "), ("b.md", "append", "y"), ("d.md", "create", "z\n\n"), ("c.md", "overwrite", "w")], "path string, mode string, content string")
    got = {r.path: (r.text, r.changed) for r in W.apply(pages, edits).collect()}
    assert got == {"a.md": ("one\n\n\nx\n", True), "b.md": ("two\n\ny\n", True), "c.md": ("w\n", True), "d.md": ("z\n", True)}
    with pytest.raises(Exception, match="already exists"):
        W.apply(pages, spark.createDataFrame([("a.md", "create", "x")], "path string, mode string, content string")).collect()


def test_ledger(wiki, tmp_path):
    head, _ = wiki.change_summary(update=True)
    first = head.first()
    assert (first.pending_events, first.added, first.total_events, first.significant_change) == (2, 2, 2, True)
    assert wiki.change_summary()[0].first().pending_events == 0 and wiki.ledger.update(wiki.files(), 1.0) == 0
    (tmp_path / "concepts/alpha.md").write_text(PAGE + "\nmore\nlines\n")
    (tmp_path / "entities/beta.md").unlink()
    (tmp_path / "raw/notes.md").write_text("changed\n")
    for _ in range(2):  # a dry run changes nothing
        head, rows = wiki.change_summary()
        assert (head.first().modified, head.first().deleted, head.first().added_lines, head.first().total_events) == (1, 1, 3, 2)
        assert {r.path: (r.change_count, r.pending) for r in rows.collect()} == {"concepts/alpha.md": (2, True), "entities/beta.md": (2, True)}
    assert wiki.change_summary(update=True)[0].first().total_events == 4
    log = wiki.ledger.log().orderBy("id").collect()
    assert [r.id for r in log] == [1, 2, 3, 4] and [r.kind for r in log] == ["added", "added", "modified", "deleted"]
    assert wiki.change_summary(changes=100, size=10**6, lines=10**6)[0].first().significant_change is False


def test_consistency(wiki, tmp_path):
    head, found = wiki.consistency_audit()
    assert {r.code for r in found.collect()} >= {"manifest_missing", "chunks_file_missing", "markdown_file_unindexed"} and not head.first().ok
    wiki.reindex()
    head, found = wiki.consistency_audit()
    assert found.collect() == [] and head.first().ok and head.first().lancedb_rows == head.first().expected_vector_rows == 4
    (tmp_path / "entities/beta.md").unlink()
    (tmp_path / "concepts/alpha.md").write_text(PAGE + "\n## More\n\ntext\n")
    codes = {r.code for r in wiki.consistency_audit()[1].collect()}
    assert codes == {"indexed_file_missing", "chunk_file_missing_source", "manifest_file_stale", "markdown_chunks_missing_from_index", "stale_chunks_in_index"}


def test_file_issues(spark):
    manifest = '{"include_raw": "no", "pages_indexed": "oops", "chunks_indexed": {}, "files": {"a.md": 7, "b.md": {"size": 1, "chunks": 2, "mtime": 1.5}, "c.md": {"size": "x", "chunks": 1, "mtime": 1}}}'
    lines = [(1, '{"id":'), (2, "[1]"), (3, '{"path": "p", "tags": 5}'), (4, " "), (5, '{"id": "i", "path": "p"}')]
    found = audit.file_issues(spark.createDataFrame([(manifest,)], "value string"), spark.createDataFrame(lines, "line int, value string"))
    got = sorted((r.code, r.path or r.field or (r.details or {}).get("line") or "") for r in found.collect())
    assert got == [("chunks_file_invalid_json", "1"), ("chunks_file_invalid_json", "2"), ("chunks_file_invalid_schema", "3"), ("manifest_file_invalid_schema", "a.md"), ("manifest_file_invalid_schema", "c.md"), ("manifest_invalid_schema", "chunks_indexed"), ("manifest_invalid_schema", "include_raw"), ("manifest_invalid_schema", "pages_indexed")]
    assert [r.code for r in audit.file_issues(spark.createDataFrame([("{",)], "value string"), None).collect()] == ["manifest_invalid_json"]


def test_verbosity_verbs(wiki, tmp_path):
    (tmp_path / "concepts/long.md").write_text("# Long\n\n" + "This sentence stands here again and again for no reason at all today.\n" * 310)
    assert [r.path for r in wiki.verbosity_audit(1).collect()] == ["concepts/long.md"]
    assert wiki.is_verbose("concepts/long.md").first().severity == "high" and wiki.is_verbose("entities/beta.md").first().severity == "ok"
    codes = {r.code for r in wiki.is_verbose("entities/beta.md", compare_to="concepts/long.md").first().reasons}
    assert "rewrite_not_compact" in codes


def test_embedding_config(monkeypatch):
    monkeypatch.setenv("LEAFMILL_EMBEDDING_DIMENSIONS", "32")
    assert EmbeddingConfig.from_env().embedder().dimensions == 32
    monkeypatch.setenv("LEAFMILL_EMBEDDING_DIMENSIONS", "many")
    with pytest.raises(ValueError):
        EmbeddingConfig.from_env()
    with pytest.raises(ValueError):
        EmbeddingConfig("none").embedder()


def test_command_line(wiki, tmp_path, capsys):
    import json

    from leafmill.cli import main

    run = lambda *args: (main(["--wiki", str(tmp_path), *args]), capsys.readouterr())
    code, out = run("index", "--json")
    assert code == 0 and json.loads(out.out)[0]["pages_indexed"] == 2
    code, out = run("search", "pressing grapes", "--limit", "1", "--json")
    assert code == 0 and [r["heading"] for r in json.loads(out.out)] == ["Pressing"]
    code, out = run("grep", "SUN", "--context", "0")
    assert code == 0 and "concepts/alpha.md" in out.out
    assert run("grep", "(", "--regex")[0] == 2 and run("write", "../x.md", "--content-file", str(tmp_path / "root.md"))[0] == 2
    assert run("write", "queries/n.md", "--content-file", str(tmp_path / "root.md"), "--no-reindex")[0] == 0
    code, out = run("write", "queries/n.md", "--content-file", str(tmp_path / "root.md"), "--no-reindex")
    assert code == 2 and "already exists" in out.err
    code, out = run("change-summary", "--json")
    assert code == 0 and json.loads(out.out)["summary"][0]["added"] == 1
    for verb in (("status",), ("read", "concepts/alpha.md", "--heading", "Pressing"), ("is-verbose", "concepts/alpha.md"), ("verbosity-audit", "--limit", "1"), ("consistency-audit",)):
        assert run(*verb)[0] == 0
