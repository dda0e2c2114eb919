"""Store, registry, sources, streams and reports."""

import hashlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestrand import config, queries, render
from lodestrand.operators import lookups, registry, vectors
from lodestrand.engine import Engine
from lodestrand.functions import indent
from lodestrand.sources import extract, files, provider
from lodestrand.sources.chunker import Windows, cut, truncate
from lodestrand.sources.filters import daemon_filter, index_directory, index_file, matches_pattern
from lodestrand.sources.sniff import is_binary
from lodestrand.store import GraphStore, StoreError
from lodestrand.streaming import debounce, workqueue
from lodestrand.streaming.daemon import Daemon, Watcher

SMALL = Windows(20, 5, 5, 100)


@pytest.mark.parametrize(
    ("data", "windows", "chunks"),
    [
        (b"test", SMALL, []),
        (b"This is a test content.", SMALL, []),
        ("".join(f"line{i:03d}\n" for i in range(10)).encode(), SMALL, [(0, 16, 1, 2), (16, 32, 3, 4), (32, 48, 5, 6), (48, 64, 7, 8), (64, 80, 9, 10)]),
        ("é\n".encode() * 12, SMALL, [(0, 18, 1, 6), (18, 33, 7, 11)]),
        (b"ab\n" * 12, Windows(10, 20, 3, 100), [(0, 9, 1, 3), (12, 18, 5, 6), (24, 30, 9, 10)]),
        (b"ab\n" * 12, Windows(20, 5, 3, 9), [(0, 9, 1, 3), (18, 24, 7, 8)]),
        (b"a" * 600, Windows(), []),
        (b"a" * 500, Windows(), [(0, 500, 1, 0)]),
        (b"a" * 299 + b"\n" + b"b" * 299 + b"\n", Windows(), [(0, 300, 1, 1)]),
    ],
)
def test_chunker(data, windows, chunks):
    assert cut(data, windows) == chunks


def test_chunks_of_the_corpus(spark):
    rows = queries.chunk_docs(spark, "/root/testdata/sf0.001")
    assert rows.count() == 492 and rows.select("doc_id").distinct().count() == 173


def test_store_and_queue(spark, tmp_path):
    with pytest.raises(StoreError):
        GraphStore.create(spark, "", 3)
    with pytest.raises(StoreError):
        GraphStore.create(spark, str(tmp_path / "x"), 0)
    store = GraphStore.create(spark, str(tmp_path / "s"), 1)
    store.health_check()
    with pytest.raises(StoreError):
        GraphStore.create(spark, str(tmp_path / "s"), 1)
    with pytest.raises(StoreError):
        GraphStore.open(spark, str(tmp_path / "s"), 4)
    with pytest.raises(KeyError):
        store.get_meta("nothing")
    store.set_meta("k", "v")
    assert store.get_meta("k") == "v"
    changes = spark.createDataFrame([("/b", 1, "h", 1), ("/a", 2, "g", 2), ("/a", 3, "k", 3)], "path string, last_mod_time long, content_hash string, seq int")
    workqueue.enqueue(store, changes)
    assert [(r.id, r.path, r.status, r.content_hash) for r in store.files.orderBy("id").collect()] == [(1, "/a", "pending", "k"), (2, "/b", "pending", "h")]

    def index(batch):
        chunks = batch.filter("path = '/a'").select(F.col("id").alias("file_id"), F.lit("Fun calls").alias("content_snippet"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
        return chunks, batch.filter("path = '/b'").select("id", F.lit("no").alias("message"))

    for n in (2, 1, 1, 0):
        assert workqueue.index_once(store, index) == n
    assert {r.path: (r.status, r.retry_count) for r in store.files.collect()} == {"/a": ("indexed", 0), "/b": ("failed", 3)}

    class Model:
        def complete(self, prompt):
            return '{"chunk":1,"source":"Fun","source_type":"FUNCTION","target":"Gun","target_type":"TYPE","relation_type":"calls"}'

    run = lambda chunks: extract.extract(chunks, Model())
    assert workqueue.extract_once(store, run) == 1 and workqueue.extract_once(store, run) == 0
    assert store.entities.count() == 2 and [r.relation_type for r in store.edges.collect()] == ["calls"]
    store.vacuum()
    assert store.files.count() == 2
    assert registry.delete_file(store.files, "/a").count() == 1
    with pytest.raises(KeyError):
        registry.delete_file(store.files, "/zzz")


def test_walk_and_sniff(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("print(1)\n")
    (tmp_path / "d" / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "secret.txt").write_text("x")
    rows = files.walk(spark, str(tmp_path), [r".*secret\.txt$"])
    assert {r.path.rsplit("/", 1)[1] for r in rows.collect()} == {"a.py", "b.png"}
    (text,) = files.texts(rows).collect()
    assert text.text == "print(1)\n" and text.content_hash == hashlib.sha256(b"print(1)\n").hexdigest()
    (tmp_path / "d" / "c.txt").write_bytes(b"caf\xe9\n")
    assert {r.text for r in files.texts(files.walk(spark, str(tmp_path / "d"))).collect()} == {"print(1)\n", "caf\ufffd\n"}
    assert not is_binary(b"") and is_binary(b"a\x00b") and not is_binary(b"  <html>\x01")


def test_filters(spark):
    def one(column, path):
        return spark.createDataFrame([(path,)], "p string").select(column(F.col("p"))).first()[0]

    p = "/data/maps"
    black, white = [r"draft/", r"[.]bak$", "**/*.txt"], [r"draft/keep"]
    for path, want in [("a/rivers.csv", True), ("draft/rivers.csv", False), ("draft/keep.csv", True), ("a/rivers.bak", False), ("draft/keep.bak", True), ("a/rivers.txt", True)]:
        assert one(lambda c: index_file(c, black, white), f"{p}/{path}") is want
    for path, exclude, want in [(f"{p}/north", ["tiles", "c?che"], True), ("/data/mapsheets", [], False), (f"{p}/cache", ["c?che"], False), (f"{p}/tiles/5", ["tiles"], False), (f"{p}/[x", ["[x"], False), (p, [], True)]:
        assert one(lambda c: index_directory(c, [p], exclude), path) is want
    for path, pattern, want in [("/m/alps.csv", "alp*.csv", True), ("/m/alps.csv", "lps", True), ("/m/alps.csv", r"a.ps\.", True), ("/m/alps.csv", "*.txt", False)]:
        assert one(lambda c: matches_pattern(c, pattern), path) is want
    assert one(lambda c: daemon_filter(c, [p], ["tiles"], [r"[.]bak$"], []), f"{p}/north/a.csv") is True
    assert [one(lambda c: daemon_filter(c, [p], ["tiles"], [r"[.]bak$"], []), f"{p}/{x}") for x in ("tiles/a.csv", "north/a.bak")] == [False, False]
    assert one(lambda c: truncate(c, 3), "abcdef") == "abc..." and one(lambda c: truncate(c, 3), "abc") == "abc"
    assert one(lambda c: indent(c, "> "), "a\nb\n") == "> a\n> b\n> "


def test_answers():
    known = {1: (11, 5), 2: (12, 5)}
    good = '{"chunk":1,"source":"A","source_type":"FUNCTION","target":"B","target_type":"TYPE","relation_type":"uses"}'
    edge = ("A", "FUNCTION", "B", "TYPE", "uses", 11, 5)
    for text in (good, f"```json\n{good}\n```", f"Sure:\n{good}", f'{good}\n{{"chunk":9}}\n{{bad'):
        assert extract.parse_jsonl(text, known) == [edge]
    for text in ('{"chunk":9,"source":"A"}', '{"chunk":"1"}', good + ","):
        with pytest.raises(extract.AnswerError):
            extract.parse_jsonl(text, known)
    assert extract.parse_jsonl("", known) == [] and extract.parse_jsonl("prose", known) == []
    assert extract.parse_jsonl('{"chunk":2,"source":"A"}', known) == [("A", "", "", "", "", 12, 5)]
    assert extract.parse_array('[{"source":"f","target":"g","relation_type":"calls"}]')[0][0] == "f"
    with pytest.raises(extract.AnswerError):
        extract.parse_array("no")
    prompt, meaning = extract.build_prompt([(7, 3, "/a", "x"), (8, 3, None, "y")])
    assert meaning == {1: (7, 3), 2: (8, 3)} and prompt.count("File:") == 1


def test_vectors(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1, 1, [1.0, 0.0]), (2, 1, "b", 1, 1, [1.0, 1.0]), (3, 2, "c", 1, 1, [0.0, 0.0]), (4, 9, "d", 1, 1, [1.0, 0.1])], "chunk_id long, file_id long, content_snippet string, start_line int, end_line int, embedding array<float>")
    paths = spark.createDataFrame([(1, "/x/a"), (2, "/y/b")], "id long, path string")
    assert [r.chunk_id for r in vectors.search(rows, paths, [1.0, 0.0], 2).collect()] == [1]
    assert [r.chunk_id for r in vectors.search(rows, paths, [1.0, 0.0], 2, prefilter=True).collect()] == [1, 2]
    assert vectors.chunk_distance(rows, 1, 77).collect() == []
    assert vectors.search_with_relations(rows, paths, [1.0, 0.0]).first().related == []
    with pytest.raises(vectors.DimensionError):
        vectors.search(rows, paths, [1.0], dim=2)
    hit = vectors.search(rows, paths, [1.0, 0.0], 1).collect()
    assert "**Distance:** 0.0000" in render.markdown_report("q", hit) and render.markdown_report("q", []) == "No results found\n"
    assert list(render.yaml_lines('a "q"', paths.limit(0))) == ['query: "a \\"q\\""', "results: []"]
    lines = list(render.yaml_lines("q", spark.createDataFrame([(1, "a\nb", None, "it's")], "n int, s string, z string, t string")))
    assert lines == ['query: "q"', "results:", "  - index: 0", "    n: 1", "    s: |", "      a", "      b", "    z: NULL", '    t: "it\'s"', "", "total: 1"]


def test_five_writes_fire_once(spark, tmp_path):
    rows = [("/a", "write", f"2024-01-01 00:00:0{i // 2}.{i % 2 * 5}00") for i in range(5)] + [("/a", "write", "2024-01-01 00:00:09"), ("/b", "remove", "2024-01-01 00:00:01")]
    events = debounce.relevant(spark.createDataFrame(rows, "path string, op string, t string").select("path", "op", F.to_timestamp("t").alias("ts")))
    want = sorted((r.path, r.n) for r in debounce.sessions(events).collect())
    assert want == [("/a", 1), ("/a", 5)] == sorted((r.path, r.n) for r in debounce.batch_sessions(events).collect())
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = debounce.sessions(stream, watermark="1 second").writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("fired").collect()[0].n == 5


def test_config(tmp_path):
    shared = config.Config(include=("/data/maps",), exclude=("tiles",), blacklist=("a",))
    local = config.Config(include=("north", "./south"), exclude=("old/",), blacklist=("b",), whitelist=("c",))
    daemon = config.merge_for_daemon(shared, local, "/data/maps")
    assert daemon.exclude == ("tiles", "/data/maps/old") and daemon.blacklist == ("a", "b") and (daemon.include, daemon.whitelist) == (shared.include, ())
    assert config.merge_for_cli(shared, local, "/data/maps").include[-2:] == ("/data/maps/north", "/data/maps/south")
    with pytest.raises(config.ConfigError):
        config.merge_for_cli(shared, config.Config(include=("/data/mapsheets",)), "/data/maps")
    with pytest.raises(config.ConfigError):
        config.check_inside("../../b", "/data/maps/north")
    assert config.resolve("../b", "/data/maps") == "/data/b" and config.check_inside("x/../y", "/data/maps") == "/data/maps/y"
    cache = config.ConfigCache(shared)
    assert cache.get(str(tmp_path / "x")) is cache.get(str(tmp_path / "x"))


def test_config_files(tmp_path):
    pytest.importorskip("yaml")
    whole = tmp_path / "global.yaml"
    whole.write_text("active_profile: maps\nprofiles:\n  maps:\n    include: [/data/maps]\n    exclude: [tiles]\n    llm_provider: openai\n")
    found = config.load_global(str(whole))
    assert (found.include, found.exclude, found.options) == (("/data/maps",), ("tiles",), {"llm_provider": "openai"})
    whole.write_text("active_profile: other\nprofiles: {maps: {}}\n")
    with pytest.raises(config.ConfigError):
        config.load_global(str(whole))
    whole.write_text("a: [")
    with pytest.raises(config.ConfigError):
        config.load_global(str(whole))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    local = tmp_path / "in" / config.LOCAL_NAME
    local.write_text("exclude: [old]\n")
    assert config.load_local(str(local)).include == ()
    merged = config.config_for_file(config.Config(), str(tmp_path / "in" / "deep" / "f.txt"))
    assert merged.exclude == (str(tmp_path / "in" / "old"),)


def test_config_listener_tells_of_local_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a").mkdir()
    path, told = tmp_path / "a" / config.LOCAL_NAME, []
    cache = config.ConfigCache(config.Config())
    cache.listen(lambda where, event: told.append((where, event)))
    assert cache.get(str(tmp_path / "a" / "f")).exclude == ()
    with config.ConfigWatcher(cache, [str(tmp_path)], poll=0.02) as watcher:
        wait = lambda n: [time.sleep(0.02) for _ in range(250) if len(told) < n]
        path.write_text("exclude: [x]\n")
        wait(1)
        assert cache.get(str(tmp_path / "a" / "f")).exclude == (str(tmp_path / "a" / "x"),)
        path.write_text("exclude: [x, y]\n")
        wait(2)
        assert len(cache.get(str(tmp_path / "a" / "f")).exclude) == 2
        path.rename(tmp_path / "a" / "gone.yaml")
        wait(3)
        assert cache.get(str(tmp_path / "a" / "f")).exclude == ()
    assert [e for _, e in told] == ["created", "modified", "deleted"] and {w for w, _ in told} == {str(path)}
    watcher.close()


def test_lookups(spark):
    edges = spark.createDataFrame([(1, 2, "calls", 1, 1.0), (1, 3, "imports", 1, 1.0)], "source_entity_id long, target_entity_id long, relation_type string, chunk_id long, weight double")
    entities = spark.createDataFrame([(1, "A", "F", 1), (2, "B", "F", 1), (3, "C", "T", 1)], "id long, name string, entity_type string, chunk_id long")
    one = entities.filter("id = 1")
    assert {r.name for r in lookups.related_entities(entities, edges, one).collect()} == {"B", "C"}
    assert {r.name for r in lookups.related_entities(entities, edges, one, "calls").collect()} == {"B"}
    assert registry.delete_edges(edges, 1).collect() == []
    left, rest = registry.delete_entities(entities, edges, entities.filter("id = 2"))
    assert left.count() == 2 and [r.target_entity_id for r in rest.collect()] == [3]


def test_engine_end_to_end(spark, tmp_path):
    class Model:
        def complete(self, prompt):
            return '{"chunk":1,"source":"Fun","source_type":"FUNCTION","target":"Gun","target_type":"TYPE","relation_type":"calls"}'

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("def parse(tokens):\n    return tree\n" * 4)
    (folder / "b.txt").write_bytes(b"caf\xe9 menu with prices and cakes\n" * 6)
    (folder / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    engine = Engine(spark, str(tmp_path / "s"), extractor=Model(), dim=64, windows=Windows(60, 20, 10, 1000))
    assert engine.index_folder(str(folder)) == 3 and engine.index_folder(str(folder)) == 0
    hits = engine.search("def parse(tokens):\n    return tree\n", 2).collect()
    assert hits and all(r.path.endswith("a.py") for r in hits)
    n, ids = engine.store.chunks.count(), [r.chunk_id for r in engine.store.chunks.collect()]
    assert len(set(ids)) == n
    assert engine.search("cakes", 50, under=str(tmp_path / "none")).collect() == []
    (folder / "b.txt").write_text("entirely new words about rivers\n" * 6)
    assert engine.index_folder(str(folder)) == 1
    assert {r.status for r in engine.store.files.collect()} == {"indexed"} and engine.store.files.count() == 3
    engine.store.write("files", registry.mark_processing(engine.store.files, engine.store.files.filter("path LIKE '%a.py'")))
    assert engine.index_folder(str(folder)) == 1 and engine.store.chunks.count() == engine.store.chunks.select("chunk_id").distinct().count()
    assert engine.sql("SELECT COUNT(*) AS n FROM {chunks} WHERE content_snippet LIKE :p", p="%cakes%").first().n == 0
    assert engine.extract_graph() == engine.store.chunks.count() and engine.extract_graph() == 0
    assert [tuple(r) for r in engine.query("MATCH (a:FUNCTION)-[:calls]->(b) RETURN b.name").collect()] == [("Gun",)]
    assert engine.hybrid_search("rivers", 3).count() == 3
    assert "Files: 3" in engine.status() and "indexed: 3" in engine.status()


def test_changes_cost_their_own_size(spark, tmp_path, monkeypatch):
    store = GraphStore.create(spark, str(tmp_path / "s"), 1)
    rows = lambda *r: spark.createDataFrame([(i, n, "T", 1) for i, n in r], "id long, name string, entity_type string, chunk_id long")
    there = lambda: {r.id: r.name for r in store.entities.collect()}
    store.write("entities", rows((1, "a"), (2, "b"), (3, "c")))
    store.merge("entities", rows((2, "B"), (4, "d")))
    assert there() == {1: "a", 2: "B", 3: "c", 4: "d"} and store.greatest("entities") == 4
    store.merge("entities", rows((2, "BB")), spark.createDataFrame([(2,), (3,)], "id long"))
    assert there() == {1: "a", 2: "BB", 4: "d"}
    (tmp_path / "s" / "entities" / "d99" / "rows").mkdir(parents=True)  # a writer that failed
    assert there() == {1: "a", 2: "BB", 4: "d"}
    names = sorted(p.name for p in (tmp_path / "s" / "entities").iterdir())
    assert names == ["d3", "d4", "d99", "v1", "v2"]
    (tmp_path / "s" / "files" / "v2").mkdir()  # and one that failed to write a whole version
    store.write("files", store.files)
    assert store.files.count() == 0 and store._versions("files") == [(3, "v")]
    monkeypatch.setattr(GraphStore, "MERGES", 2)
    store.merge("entities", rows((1, "A")))
    assert [kind for _, kind in store._versions("entities")] == ["v"] and there() == {1: "A", 2: "BB", 4: "d"}
    store.vacuum()
    assert there() == {1: "A", 2: "BB", 4: "d"}


def test_a_batch_writes_only_its_own_files(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"), 1)
    changes = spark.createDataFrame([(f"/{k:03d}", k, "h", 0) for k in range(200)], "path string, last_mod_time long, content_hash string, seq int")
    workqueue.enqueue(store, changes)

    def index(batch):
        return batch.select(F.col("id").alias("file_id"), F.lit("x").alias("content_snippet"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding")), batch.filter("id = 3").select("id", F.lit(None).cast("string").alias("message"))

    assert workqueue.index_once(store, index) == 5
    changed = [spark.read.parquet(str(tmp_path / "s" / t / f"d{n}" / "rows")).count() for t, n in (("files", 3), ("files", 4), ("chunks", 2))]
    assert changed == [5, 5, 4]
    states = {r.id: (r.status, r.retry_count, r.error_message) for r in store.files.filter("id <= 6").collect()}
    assert states[3] == ("pending", 1, registry.NO_MESSAGE) and states[6] == ("pending", 0, None) and states[1] == ("indexed", 0, None)

    def wrong(batch):
        chunks, none = index(batch)
        return chunks.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")), none

    with pytest.raises(vectors.DimensionError):
        workqueue.index_once(store, wrong)
    assert store.chunks.count() == 4


def test_failing_answers_are_rows(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"), 1)
    store.write("files", spark.createDataFrame([(1, "/a", 0, "h", None, "indexed", None, 0, None)], store.files.schema))
    store.write("chunks", spark.createDataFrame([(k, 1, f"text {k}", 1, 1, [1.0]) for k in (1, 2, 100, 200)], store.chunks.schema))

    class Model:
        def complete(self, prompt):
            if "text 100" in prompt:
                raise OSError("no connection")
            if "text 200" in prompt:
                return '{"chunk": 7}'
            line = '{"chunk":%d,"source":"a","source_type":"T","target":"b","target_type":"T","relation_type":"%s"}'
            return "\n".join(line % (n, r) for n in (1, 2) for r in ("uses", "calls"))

    run = lambda chunks: extract.extract(chunks, Model())
    good, edges, failures = workqueue.process_chunks(store, lookups.needing_extraction(store.chunks, store.state), run)
    assert (good, edges) == (2, 4)
    assert {r.chunk_id: r.message for r in failures.collect()}.keys() == {100, 200}
    assert sorted((r.chunk_id, r.relation_type) for r in store.edges.collect()) == [(1, "calls"), (2, "calls")]
    assert workqueue.extract_once(store, run) == 0 and store.entities.count() == 4
    with pytest.raises(extract.AnswerError):
        extract.parse_array('["x"]')
    assert extract.extract_edges("code", type("M", (), {"complete": lambda self, p: '[{"source":"f"}]'})()) == [("f", "", "", "", "")]


def test_one_file_and_files_that_cannot_be_read(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("short\n")
    (tmp_path / "in" / "b.txt").write_text("far too long to be read\n")
    (tmp_path / "in" / "c.bak").write_text("x\n")
    monkeypatch.setattr(files, "MOST_BYTES", 10)
    one = str(tmp_path / "in" / "c.bak")
    assert files.walk(spark, one, [r"[.]bak$"]).count() == 1
    assert [r.path for r in files.walk(spark, str(tmp_path / "in"), [r"[.]bak$"]).collect()] == [str(tmp_path / "in" / "a.txt")]
    assert [tuple(r) for r in files.unreadable(spark, str(tmp_path / "in")).collect()] == [(str(tmp_path / "in" / "b.txt"), "the file is too long")]
    engine = Engine(spark, str(tmp_path / "s"), dim=8)
    assert engine.queue(str(tmp_path / "in"), [r"[.]bak$"]) == {"queued": 1, "skipped": 1, "errors": 1}
    assert engine.queue(one, [r"[.]bak$"]) == {"queued": 1, "skipped": 0, "errors": 0}
    (tmp_path / "in" / "a.txt").unlink()
    assert engine.index_once() == 2
    assert {r.path.rsplit("/", 1)[1]: (r.status, r.error_message) for r in engine.store.files.collect()} == {"a.txt": ("pending", "the file can't be read"), "c.bak": ("indexed", None)}


def test_daemon_follows_folders(spark, tmp_path):
    class Model:
        def complete(self, prompt):
            return '{"chunk":1,"source":"A","source_type":"T","target":"B","target_type":"T","relation_type":"calls"}'

    folder = tmp_path / "in"
    (folder / "tiles").mkdir(parents=True)
    (folder / "a.txt").write_text("first words of a file\n")
    (folder / "b.bak").write_text("a copy that nobody wants\n")
    (folder / "tiles" / "t.txt").write_text("an excluded folder's file\n")
    engine = Engine(spark, str(tmp_path / "s"), extractor=Model(), dim=16)
    daemon = Daemon(engine, [str(folder)], ["tiles"], [r"[.]bak$"], debounce=0)
    assert daemon.step() == {"queued": 1, "indexed": 1, "extracted": 1}
    assert daemon.step() == {"queued": 0, "indexed": 0, "extracted": 0}
    (folder / "a.txt").write_text("other words in the same file\n")  # a change to a known file
    stop, told = threading.Event(), []
    daemon.tell = lambda line: (told.append(line), stop.set())
    worker = threading.Thread(target=daemon.run, args=(stop, 0.05))
    worker.start()
    worker.join(120)
    assert told == ["queued 1, indexed 1, extracted 1"]
    assert [r.content_snippet for r in engine.store.chunks.collect()] == ["other words in the same file\n"]


def test_watched_folders(spark, tmp_path):
    watcher = Watcher(spark, debounce=0)
    assert watcher.poll() is None
    watcher.watch(str(tmp_path)), watcher.watch(str(tmp_path))
    assert watcher.watched() == [str(tmp_path)]
    (tmp_path / "f").write_text("x")
    assert [r.path for r in watcher.poll().collect()] == [str(tmp_path / "f")]
    watcher.unwatch(str(tmp_path)), watcher.unwatch(str(tmp_path))
    assert watcher.watched() == [] and watcher.poll() is None
    watcher.watch(str(tmp_path))
    slow = Watcher(spark, debounce=3600)
    slow.watch(str(tmp_path))
    assert slow.poll().count() == 0  # not quiet yet
    watcher.close(), watcher.close()
    assert watcher.watched() == []


@pytest.fixture
def service():
    """A model server: counts requests, fails as often as it is told to."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.answer(200, "up")

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            state["seen"].append((self.path, body, self.headers.get("Authorization")))
            if state["fail"]:
                return self.answer(state["fail"].pop(0), "no")
            if self.path == provider.EMBED:
                return self.answer(200, {"embedding": [float(len(body["prompt"])), 1.0]} if body["prompt"] else {})
            if self.path.endswith(provider.CHAT):
                return self.answer(200, {"choices": [{"message": {"content": "chat"}}] if state["choices"] else []})
            return self.answer(200, {"response": "text"})

        def answer(self, code, body):
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    state = {"seen": [], "fail": [], "choices": True}
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def test_local_model(service):
    model = provider.LocalModel("m", service["url"], delay=0.01, retries=2)
    model.ping()
    assert model.embed(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
    with pytest.raises(provider.ProviderError, match="text 1"):
        model.embed(["a", ""])
    service["seen"].clear()
    assert model.generate("p", "s") == "text" and model.complete("p") == "text"
    assert [b.get("format") for _, b, _ in service["seen"]] == [None, "json"] and service["seen"][0][1]["system"] == "s"


def test_requests_are_tried_again(service):
    model = provider.LocalModel("m", service["url"], delay=0.01, retries=2)
    service["fail"] = [503, 429]
    assert model.generate("p") == "text" and len(service["seen"]) == 3
    service["fail"] = [500, 500, 500]
    with pytest.raises(provider.ProviderError, match="status 500"):
        model.generate("p")
    service["seen"].clear()
    service["fail"] = [404]
    with pytest.raises(provider.ProviderError, match="status 404"):
        model.generate("p")
    assert len(service["seen"]) == 1
    began = time.time()
    with pytest.raises(provider.ProviderError):
        provider.LocalModel("m", "http://127.0.0.1:9", delay=0.05, retries=2).ping()
    assert time.time() - began >= 0.15


def test_chat_model_and_choice(service):
    model = provider.ChatModel("m", service["url"], "key", delay=0.01)
    assert model.complete("p") == "chat"
    path, body, key = service["seen"][0]
    assert path == provider.CHAT and key == "Bearer key" and [m["role"] for m in body["messages"]] == ["system", "user"]
    service["choices"] = False
    with pytest.raises(provider.ProviderError):
        model.complete("p")
    kind = lambda **options: type(provider.choose(options)[1]).__name__
    assert kind() == "LocalModel" and kind(llm_base_url="https://openrouter.ai/v1") == "ChatModel" and kind(llm_provider="OpenAI") == "ChatModel"
    assert kind(llm_provider="ollama", llm_base_url="https://api.openai.com/v1") == "LocalModel"
    embedder, graph = provider.choose({"llm_base_url": "http://far:1", "graph_driver": {"model": "g"}, "embedding_model": "e"})
    assert (embedder.base_url, embedder.model, graph.base_url, graph.model) == (provider.LOCAL, "e", "http://far:1", "g")


def test_model_server_serves_an_engine(service, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one line of text\n" * 3)
    engine = Engine(spark, str(tmp_path / "s"), provider.LocalModel("m", service["url"]), dim=2)
    assert engine.index_folder(str(tmp_path / "in")) == 1
    assert [r.embedding for r in engine.store.chunks.collect()] == [[51.0, 1.0]]
    with pytest.raises(vectors.DimensionError):
        Engine(spark, str(tmp_path / "t"), provider.LocalModel("m", service["url"]), dim=3).index_folder(str(tmp_path / "in"))


def test_related_chunks_in_reports(spark):
    hit = {"path": "/a.py", "content_snippet": "x", "start_line": 1, "end_line": 2, "distance": 0.5, "chunk_id": 1, "related": [{"chunk_id": 9, "relation": "calls"}, {"chunk_id": 8, "relation": "uses"}]}
    text = render.markdown_report("q", [hit], {9: {"path": "/b.go", "content_snippet": "y\n", "start_line": 3, "end_line": 4}})
    assert "### Related Chunks\n\n#### 1/2: /b.go (calls) - Lines 3-4\n\n```go\ny\n```\n\n" in text and "#### 2/2" not in text
    with pytest.raises(vectors.ChunkError):
        vectors.chunk_distance(spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>"), 1, 2, strict=True)


def test_sniffing_of_containers():
    box = lambda brand: (24).to_bytes(4, "big") + b"ftyp" + brand + b"\0\0\0\1" + b"isomavc1"
    assert is_binary(box(b"mp42") + b"text") and is_binary(b"RIFF1234WAVEfmt ") and is_binary(b"RIFF1234WEBPVP8 ")
    assert not is_binary(b"Rxxxftyp is plain text here") and not is_binary(b"RIFF is a word, WAVE too")


def test_tasks_of_the_queue_are_told(spark, tmp_path):
    told = []
    listener = workqueue.StatusListener(told.append)
    spark.streams.addListener(listener)
    rows = spark.createDataFrame([("/a", 1, "h")], "path string, last_mod_time long, content_hash string")
    rows.write.parquet(str(tmp_path / "in"))
    store = GraphStore.create(spark, str(tmp_path / "s"), 1)
    query = workqueue.run_queue(store, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), once=True)
    query.awaitTermination(60)
    assert [r.path for r in store.files.collect()] == ["/a"]
    for _ in range(100):
        if any(line.startswith("ended") for line in told):
            break
        time.sleep(0.05)
    spark.streams.removeListener(listener)
    assert told[0].startswith("started") and any("1 rows" in line for line in told)


def test_tables_in_the_shared_folder_go_after_use(spark, tmp_path, monkeypatch):
    import os

    from lodestrand import storage

    made, path_of = [], storage.shared_path
    monkeypatch.setattr(storage, "shared_path", lambda *args: made.append(path_of(*args)) or made[-1])
    there = lambda: [p for p in made if os.path.exists(p.removeprefix("file:"))]
    with storage.cleared(spark) as keep:
        storage.settled(spark.range(3), "gone")
        rows, path = storage.settled_at(spark.range(4), "kept")
        keep.add(path)
        with storage.cleared(spark):
            storage.settled(spark.range(5), "inner")
        assert len(there()) == 2
    assert rows.count() == 4 and there() == [path]
    storage.remove(spark, path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some words in a file\n")
    engine = Engine(spark, str(tmp_path / "s"), dim=4)
    assert engine.index_folder(str(tmp_path / "in")) == 1 and engine.store.chunks.count() == 1
    assert len(made) > 5 and there() == []
