"""The store, the build and the command line, end to end on a folder of Markdown."""

import json

import pytest

from lattice import cli
from lattice.config import DEFAULTS, load_config, merged
from lattice.operators.upsert import fold_attributes, upsert_entities
from lattice.plans import build
from lattice.sources.markdown import scan_markdown
from lattice.sources.models import CallLog, ChatModel, HashEmbedder, ParseFailure, PatternModel, ask
from lattice.sources.store import Store, build_lock
from lattice.streaming.ingest import stream_ingest

FILES = {
    "ana.md": "# Ana\n\nAna Ruiz works at Orbit Corp. She is busy.",
    "notes/sol.md": "# Sol\r\n\r\nAna Ruiz leads Sunrise Project. Ben Okoye works at Nadir Group.",
    ".hidden/x.md": "Zed Zed works at Zed Corp.",
    "notes/skip.txt": "no",
}


@pytest.fixture
def corpus(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return tmp_path


def test_scan(spark, corpus):
    rows = {r.path: r for r in scan_markdown(spark, str(corpus)).collect()}
    assert set(rows) == {"ana.md", "notes/sol.md"}
    assert "\r" not in rows["notes/sol.md"].content
    assert rows["notes/sol.md"].size_bytes == len(FILES["notes/sol.md"].replace("\r\n", "\n"))
    assert {r.path for r in scan_markdown(spark, str(corpus), ["notes", "gone"]).collect()} == {"notes/sol.md"}
    assert scan_markdown(spark, str(corpus / "gone")).count() == 0
    assert {r.path for r in scan_markdown(spark, f"file://{corpus}").collect()} == {"ana.md", "notes/sol.md"}
    assert {r.path for r in scan_markdown(spark, f"file://{corpus}/", ["ana.md", ".hidden", "notes/skip.txt"]).collect()} == {"ana.md"}


def test_build_and_rebuild(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "graph"))
    store.init()
    store.init()
    config, embedder = merged(DEFAULTS, None), HashEmbedder(32)
    first = build.build(store, corpus, config, embedder, PatternModel())
    assert first["ingest"] == {"new": 2, "updated": 0, "skipped": 0, "chunks_created": 2}
    assert first["extract"]["documents_processed"] == 2
    assert first["extract"]["relations_inserted"] == 3
    graph = store.read()
    assert {r.canonical_name for r in graph.entities.collect()} >= {"Ana Ruiz", "Orbit Corp", "Ben Okoye", "Nadir Group"}
    assert {r.predicate for r in graph.relations.collect()} == {"works_at", "leads"}
    ids = {r.canonical_name: r.id for r in graph.entities.collect()}
    again = build.build(store, corpus, config, embedder, PatternModel())
    assert again["ingest"] == {"new": 0, "updated": 0, "skipped": 2, "chunks_created": 0}
    assert again["extract"]["documents_processed"] == 0
    assert again["chunks_embedded"] == again["mentions_embedded"] == 0
    assert {r.canonical_name: r.id for r in store.read().entities.collect()} == ids
    untouched = [r for r in store.read().chunks.collect() if "Ruiz works" in r.content]
    (corpus / "notes/sol.md").write_text("Ben Okoye leads Nadir Group.")
    changed = build.ingest(store, str(corpus), config)
    assert changed == {"new": 0, "updated": 1, "skipped": 1, "chunks_created": 1}
    graph = store.read()
    assert [r for r in graph.chunks.collect() if "Ruiz works" in r.content] == untouched
    assert max(r.id for r in graph.chunks.collect()) == 3  # ids are never used again
    assert graph.relations.filter("evidence_chunk_id is null").count() == 2
    assert build.extract(store, PatternModel())["documents_processed"] == 1
    with pytest.raises(ValueError, match="embedded with"):
        build.embed(store, HashEmbedder(16), "chunks")
    (corpus / "ana.md").unlink()
    assert build.ingest(store, str(corpus), config)["skipped"] == 1
    assert store.read().documents.count() == 2
    build.ingest_scan(store, scan_markdown(spark, str(corpus)), config, prune=True)
    assert store.read().documents.count() == 1
    whole = {t: df.count() for t, df in store.read().tables().items()}
    assert store.vacuum() > 0
    assert {t: df.count() for t, df in store.read().tables().items()} == whole
    assert store.vacuum() == 0
    store.reset()
    assert store.read().entities.count() == 0
    assert store.read().documents.filter("last_extracted_hash is null").count() == 1
    store.reset(hard=True)
    assert store.read().documents.count() == 0
    assert store.next_id("chunks") == 4


def test_new_documents_only_add_rows(spark, corpus, tmp_path, monkeypatch):
    """A commit of new documents leaves the folders of all tables; a table of many folders is written whole again."""
    store = Store(spark, str(tmp_path / "graph"))
    store.init()
    config, embedder = merged(DEFAULTS, None), HashEmbedder(8)
    build.build(store, corpus, config, embedder, PatternModel())
    before, rows = store.pointer()["tables"], {t: set(map(tuple, df.collect())) for t, df in store.read().tables().items() if t in ("chunks", "mentions", "relations")}
    (corpus / "later.md").write_text("Cleo Marsh works at Orbit Corp.")
    build.build(store, corpus, config, embedder, PatternModel())
    after, now = store.pointer()["tables"], store.read().tables()
    for t in ("documents", "chunks", "chunk_vectors", "mentions", "relations"):
        if t != "documents":
            assert after[t][: len(before[t])] == before[t], t
        assert len(after[t]) == len(before[t]) + (t != "documents"), t
    assert all(old <= set(map(tuple, now[t].collect())) for t, old in rows.items())
    assert "Cleo Marsh" in {r.canonical_name for r in now["entities"].collect()}
    monkeypatch.setattr("lattice.sources.store.FOLDERS", 2)
    whole = now["chunks"].count()
    (corpus / "last.md").write_text("Nothing.")
    build.ingest(store, str(corpus), config)
    assert len(store.pointer()["tables"]["chunks"]) == 1
    assert store.read().chunks.count() == whole + 1


class Flaky:
    """Fails on one text; names one entity in the others."""

    model = "flaky"

    def extract(self, text, entity_types, predicates):
        if "busy" in text:
            raise RuntimeError("no answer")
        return {"entities": [{"surface_form": "S", "canonical_name": "S", "entity_type": "Big Thing", "attributes": "{}", "char_start": None, "char_end": None, "confidence": None}], "relations": []}


def test_failed_chunks_stay_due(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "graph"))
    store.init()
    build.ingest(store, str(corpus), DEFAULTS)
    found = build.extract(store, Flaky())
    assert found["chunks_failed"] == 1
    assert [r.path for r in store.read().documents.filter("last_extracted_hash is null").collect()] == ["ana.md"]
    assert [r.entity_type for r in store.read().entities.collect()] == ["big_thing"]
    assert build.extract(store, PatternModel())["documents_processed"] == 1
    mentions = store.read().mentions.count()
    build.extract(store, PatternModel(), force=True)
    assert store.read().mentions.count() >= mentions - 1


def test_attribute_merge(spark):
    known = spark.createDataFrame([(1, "A", "t", '{"x": 1, "y": "q"}', "t0", "t0"), (2, "B", "t", '{"k": 1.50}', "t0", "t0")], "id long, canonical_name string, entity_type string, attributes string, created_at string, updated_at string")
    found = spark.createDataFrame([(5, "A", "T", '{"z": [1, "b"], "x": "new"}'), (6, "A", "t", '{"z": null}'), (7, "C C", "My Type", "{}")], "seq long, canonical_name string, entity_type string, attributes string")
    rows = {r.canonical_name: r for r in upsert_entities(known, found, "t1").collect()}
    assert list(json.loads(rows["A"].attributes).items()) == [("x", "new"), ("y", "q"), ("z", None)]
    assert rows["B"].attributes == '{"k": 1.50}'
    assert (rows["B"].updated_at, rows["A"].updated_at, rows["A"].created_at) == ("t0", "t1", "t0")
    assert (rows["C C"].id, rows["C C"].entity_type, rows["C C"].attributes) == (3, "my_type", "{}")


def test_attributes_are_never_lost(spark):
    """Repeated names, floats, malformed text and nulls, against Python's own reading of the objects."""
    texts = ['{"a": 1, "a": 2, "b": 3}', '{"x": 1.0, "e": "1.0", "t": true, "n": null}', '{"bad', "[1, 2]", '{"b": {"k": 1.0, "k": 2}, "q": "é\\n\\"{}"}', None, "", "{}", '{"s": "[1]", "o": {"z": [1, "b"]}}']
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "{}"), (3, 0, '{"y": 2.5}')], "k int, seq int, attributes string")
    got = {r.k: json.loads(r.attributes) for r in fold_attributes(rows, ["k"]).collect()}
    assert set(got) == {1, 3}
    expected = {}
    for t in texts:
        if t in ('{"bad', "[1, 2]"):
            expected["_unparsed"] = t
        elif t:
            expected |= json.loads(t)
    expected["b"] = got[1]["b"]
    assert got[1] == expected
    assert list(got[1]) == list(expected)
    assert got[1]["b"]["k"] in (1.0, 2)
    assert isinstance(got[1]["x"], float)


def test_call_log(tmp_path):
    model = ChatModel(lambda m: '{"entities": [], "relations": []}', log=CallLog(str(tmp_path / "calls.log")))
    model.extract("text", "", "")
    assert json.loads((tmp_path / "calls.log").read_text())["ok"]
    CallLog(str(tmp_path / "gone" / "x"))({})


def test_retries():
    answers = iter(["not json", '{"a": ', '```json\n{"entities": [], "relations": []}\n```'])
    said = []
    model = ChatModel(lambda m: (said.append(m[-1]["content"]), next(answers))[1])
    assert model.extract("text", "", "") == {"entities": [], "relations": []}
    assert len(said) == 3
    assert "cut off" in said[1]
    with pytest.raises(ParseFailure):
        ask(lambda m: "{}", "s", "u", lambda x: x["missing"], retries=1)
    with pytest.raises(RuntimeError):
        ask(lambda m: (_ for _ in ()).throw(RuntimeError("down")), "s", "u", dict)


class Silent:
    model = "silent"

    def induce(self, *told):
        return "entity_types:\n  person: {}\nrelation_types: {}\n" if len(told) == 4 else "just text"


def test_induction_keeps_the_first_schema(spark, tmp_path, seeded):
    store = Store(spark, str(tmp_path / "graph"))
    store.init()
    assert build.induce(store, DEFAULTS, Silent()) == {"entity_type_count": 0, "relation_type_count": 0}
    store.commit(**{t: df for t, df in seeded.tables().items() if t != "kv"})
    assert build.induce(store, DEFAULTS, Silent()) == {"entity_type_count": 1, "relation_type_count": 0}
    assert build.induce(store, DEFAULTS, PatternModel()) == {"entity_type_count": 3, "relation_type_count": 3}
    assert store.read().schema_versions.count() == 2


def test_lock(tmp_path):
    with build_lock(str(tmp_path)), pytest.raises(RuntimeError, match="another build"), build_lock(str(tmp_path)):
        pass
    with build_lock(str(tmp_path)):
        pass


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "user"))
    (tmp_path / "user/lattice").mkdir(parents=True)
    (tmp_path / "user/lattice/config.yaml").write_text("chunking: {max_chars: 7, overlap_chars: 1}\ncorpus: {include: [a]}")
    (tmp_path / ".lattice").mkdir()
    (tmp_path / ".lattice/config.yaml").write_text("chunking: {max_chars: 9}\ncorpus: {include: [b, c]}")
    found = load_config(tmp_path)
    assert found["chunking"] == {"max_chars": 9, "overlap_chars": 1, "split_on": "paragraph"}
    assert found["corpus"]["include"] == ["b", "c"]
    assert DEFAULTS["chunking"]["max_chars"] == 4000


def test_command_line(spark, corpus, monkeypatch, capsys):
    monkeypatch.chdir(corpus)
    run = lambda *a: cli.main(list(a), spark)
    with pytest.raises(SystemExit):
        run("stats")
    assert run("init", "--path", str(corpus)) == 0
    assert run("build", str(corpus)) == 0
    capsys.readouterr()
    read = lambda *a: (run(*a), json.loads(capsys.readouterr().out))[1]
    assert read("stats", "--json")["documents"] == 2
    assert "Ana Ruiz" in [e["name"] for e in read("entities", "--json")]
    assert len(read("relations", "--predicate", "works_at", "--json")) == 2
    assert read("entity", "Ana Ruiz", "--json")["type"] == "person"
    assert len(read("neighbors", "Ana Ruiz", "--json")["nodes"]) == 3
    assert len(read("path", "Orbit Corp", "Sunrise Project", "--json")) == 2
    assert "person" in read("schema", "--json")["schema"]["entity_types"]
    assert read("find", "Ana works", "--limit", "1", "--json")[0]["document_path"] in FILES
    assert len(read("export", "--format", "jsonld")["@graph"]) > 4
    run("export", "--format", "graphml", "--output", "out.xml")
    assert (corpus / "out.xml").read_text().startswith("<?xml")
    assert run("reset", "--hard", "--yes") == 0
    assert read("stats", "--json")["documents"] == 0


def test_streaming(spark, corpus, tmp_path):
    store = Store(spark, str(tmp_path / "graph"))
    store.init()
    for _ in range(2):
        stream_ingest(store, str(corpus), DEFAULTS, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        assert {r.path for r in store.read().documents.collect()} == {"ana.md", "notes/sol.md"}
    (corpus / "new file.md").write_text("Later.")
    stream_ingest(store, str(corpus), DEFAULTS, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert "new file.md" in {r.path for r in store.read().documents.collect()}
