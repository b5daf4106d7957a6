"""Remote sources against a local fake, versioned tables, caches, resumed syncs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quarry.operators import caches, incremental
from quarry.sources import recorded, remote, tables
from quarry.streaming import windows

PAGES = [{"id": i, "title": f"page {i}", "body": f"<p>{i}</p>", "space": "S", "url": f"/wiki/{i}", "labels": ["a", f"l{i % 3}"], "lastModified": f"2024-01-{1 + i % 28:02}T00:00:00Z"} for i in range(23)]
TICKETS = {p: [{"key": f"{p}-{i}", "summary": f"s{i}", "status": "Open", "created": "2024-01-01T00:00:00Z", "updated": "2024-01-02T00:00:00Z"} for i in range(n)] for p, n in (("AB", 7), ("CD", 3))}
FILES = [{"id": "d1", "name": "doc", "mimeType": remote.DOCUMENT, "modifiedTime": "2024-01-01T00:00:00Z"}, {"id": "s1", "name": "sheet", "mimeType": remote.SHEET}, {"id": "t1", "name": "notes", "mimeType": "text/plain"}, {"id": "p1", "name": "picture", "mimeType": "image/png"}]
BODIES = {"d1": "a document", "s1": 'h1,h2\n,\n"x|y",2\n3\n', "t1": "plain", "p1": "bits"}


class Fake(BaseHTTPRequestHandler):
    failures = 3
    asked: list[str] = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        url, ask = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Fake.asked.append(self.path)
        if Fake.failures > 0:  # the first requests fail, as busy services do
            Fake.failures -= 1
            return self.send_error(503 if Fake.failures % 2 else 429)
        if self.headers.get("Authorization") != "Bearer t":
            return self.send_error(401)
        if url.path == "/rest/api/content":
            found = [p for p in PAGES if p["lastModified"] >= ask.get("since", "")]
            answer = json.dumps({"results": found[int(ask["start"]) : int(ask["start"]) + int(ask["limit"])]})
        elif url.path == "/rest/api/search":
            at, own = int(ask.get("token", 0)), TICKETS[ask["project"]]
            after = at + int(ask["limit"])
            answer = json.dumps({"issues": own[at:after], **({"nextPageToken": str(after)} if after < len(own) else {})})
        elif url.path == "/files":
            at = int(ask.get("pageToken", 0))
            found = [f for f in FILES if "q" not in ask or f"mimeType='{f['mimeType']}'" in ask["q"]]
            answer = json.dumps({"files": found[at : at + 2], **({"nextPageToken": str(at + 2)} if at + 2 < len(found) else {})})
        elif url.path.startswith("/files/"):
            answer = BODIES[url.path.split("/")[2]]
        else:
            return self.send_error(404)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer.encode())


@pytest.fixture(scope="module")
def host(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote.register(spark)
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def read(spark, host, kind, **options):
    return spark.read.format(kind).options(url=host, token="t", pause="0.01", tries="6", **options).load()


def test_wiki_pages(spark, host):
    rows = read(spark, host, "quarry_wiki", pagesize="4", readers="3").collect()
    assert sorted(r.page_id for r in rows) == list(range(23)) and next(r for r in rows if r.page_id == 4).labels == ["a", "l1"]
    since = read(spark, host, "quarry_wiki", since="2024-01-10T00:00:00Z").select("page_id").collect()
    assert sorted(r.page_id for r in since) == list(range(9, 23))


def test_tickets_by_token_and_cap(spark, host):
    x = read(spark, host, "quarry_tickets", projects="AB,CD", pagesize="2")
    assert sorted(r.key for r in x.collect()) == sorted(t["key"] for own in TICKETS.values() for t in own)
    assert {(r.project, r.n) for r in read(spark, host, "quarry_tickets", projects="AB,CD", pagesize="2", most="5").groupBy("project").agg(F.count("*").alias("n")).collect()} == {("AB", 5), ("CD", 3)}


def test_drive_files_by_type(spark, host):
    rows = {r.id: r.content for r in read(spark, host, "quarry_drive", types=f"{remote.DOCUMENT},{remote.SHEET},text/plain", filesperreader="1").collect()}
    assert rows == {"d1": "a document", "s1": "| h1 | h2 |\n| --- | --- |\n| x\\|y | 2 |\n| 3 |  |", "t1": "plain"}


def asked(df):
    """Rows, and the requests that the fake got for them."""
    Fake.asked = []
    return df.collect(), list(Fake.asked)


def test_filters_reach_the_services(spark, host):
    wiki = read(spark, host, "quarry_wiki", pagesize="50", readers="1")
    rows, requests = asked(wiki.filter("updated >= timestamp'2024-01-10 00:00:00'"))
    assert sorted(r.page_id for r in rows) == list(range(9, 23)) and all("since=2024-01-10T00%3A00%3A00.000Z" in r for r in requests)
    later, _ = asked(wiki.filter("updated > timestamp'2024-01-10 00:00:00' AND title <> 'page 12'"))
    assert sorted(r.page_id for r in later) == [i for i in range(10, 23) if i != 12]
    rows, requests = asked(read(spark, host, "quarry_tickets", projects="AB,CD").filter("project = 'CD'"))
    assert len(rows) == 3 and all("project=CD" in r for r in requests)
    rows, requests = asked(read(spark, host, "quarry_drive").filter("type in ('text/plain', 'image/png')"))
    assert {r.id for r in rows} == {"t1", "p1"} and any("text%2Fplain" in r and "image%2Fpng" in r for r in requests if r.startswith("/files?"))
    assert not read(spark, host, "quarry_tickets", projects="AB,CD").filter("project = 'XY'").collect()


@pytest.fixture
def wiki_rows(spark):
    return lambda low, high, day: spark.createDataFrame([(i, f"t{i}", f"2024-02-{day:02} 00:{i:02}:00") for i in range(low, high)], "id long, title string, at string").withColumn("updated", F.to_timestamp("at"))


def record_wiki(rows, folder, first):
    raw = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.concat("title", F.lit(" "), "at").alias("title"), F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastModified")))
    recorded.record(rows, folder, "id", "updated", raw, first={"": first})


def test_recorded_pages_are_served_like_the_service(spark, tmp_path, wiki_rows):
    folder = str(tmp_path / "wiki")
    record_wiki(wiki_rows(0, 23, 1), folder, 0)
    record_wiki(wiki_rows(5, 9, 2), folder, 23)
    x = spark.read.format("quarry_wiki").options(url=folder, pagesize="4", readers="3").load()
    assert sorted(r.page_id for r in x.collect()) == sorted([*range(23), *range(5, 9)])
    assert sorted(r.page_id for r in x.filter("updated >= timestamp'2024-02-01 00:20:00'").collect()) == [5, 6, 7, 8, 20, 21, 22]
    assert spark.read.format("quarry_wiki").options(url=f"file:{folder}", pagesize="4").load().count() == 27
    assert recorded.answer(str(tmp_path), "rest/api/content", {"limit": 5}) == b'{"results": []}'


def test_a_request_reads_its_own_files_only(spark, tmp_path, monkeypatch):
    """Pages, tokens, times and bodies over many files: each answer is right, and opens a few files however many there are."""
    folder, opened = str(tmp_path / "kept"), []
    monkeypatch.setattr(recorded, "ROWS", 10)
    rows = spark.range(400).withColumn("updated", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60)).repartition(7)
    even = F.when(F.col("id") % 2 == 0, "even").otherwise("odd")
    raw = F.to_json(F.struct(F.col("id").cast("string").alias("id"), even.alias("mimeType"), F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastModified")))
    recorded.record(rows.filter("id < 300"), folder, "id", "updated", raw, kind=even, body=F.concat(F.lit("b"), "id"))
    recorded.record(rows.filter("id >= 300 OR id = 7").withColumn("updated", F.when(F.col("id") == 7, F.lit("2025-01-01").cast("timestamp")).otherwise(F.col("updated"))), folder, "id", "updated", raw, kind=even, body=F.concat(F.lit("c"), "id"), first={"": 300})
    real = recorded.pq.read_table
    monkeypatch.setattr(recorded.pq, "read_table", lambda path, **k: opened.append(path) or real(path, **k))
    ask = lambda path, **q: json.loads(recorded.answer(folder, path, q))
    want = [*range(400), 7]
    for start in (0, 5, 290, 395):
        assert [int(p["id"]) for p in ask("rest/api/content", start=start, limit=20)["results"]] == want[start : start + 20]
    for minute in (0, 123, 299, 300, 399):
        since = f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00.000Z"
        assert [int(p["id"]) for p in ask("rest/api/content", start=3, limit=4, since=since)["results"]] == want[minute + 3 : minute + 7]
    assert ask("rest/api/content", newest=1, limit=1)["results"][0]["id"] == "7" and not ask("rest/api/content", start=401, limit=9)["results"]
    assert ask("rest/api/content", start=0, limit=3, since="2026-01-01T00:00:00.000Z") == {"results": []}
    assert ask("files", pageToken="300", pageSize=100, fields="nextPageToken") == {"nextPageToken": "400"} and ask("files", pageToken="400", pageSize=100, fields="nextPageToken") == {}
    assert {k: recorded.answer(folder, f"files/{k}", {}) for k in ("0", "7", "299", "300", "399", "x", "")} == {"0": b"b0", "7": b"c7", "299": b"b299", "300": b"c300", "399": b"c399", "x": b"", "": b""}
    opened.clear()
    ask("rest/api/content", start=100, limit=20, since="2024-01-01T01:00:00.000Z")
    recorded.answer(folder, "files/222", {})
    assert 0 < len(opened) < 10  # of some 80
    remote.register(spark)
    spark_read = spark.read.format("quarry_drive").options(url=folder, types="odd", filesperreader="30").load()
    assert sorted(r.content for r in spark_read.collect()) == sorted([f"{'b' if i < 300 else 'c'}{i}" for i in want if i % 2 and i != 7] + ["c7", "c7"])
    assert spark_read.rdd.getNumPartitions() == 14  # a task a page, not a task twenty files


def test_a_restarted_stream_loses_and_repeats_nothing(spark, tmp_path, wiki_rows, monkeypatch):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("wiki", "table", "checkpoint"))

    def run(excluded=None):
        stream = spark.readStream.format("quarry_wiki").options(url=folder, pagesize="4", readers="2").load()
        return windows.synced(stream, path, "page_id", "updated", checkpoint, excluded).awaitTermination()

    def state():
        at = tables.at(spark, path)
        return {r.page_id: r.title for r in spark.read.parquet(f"{at}/rows").collect()}, sorted(map(tuple, spark.read.parquet(f"{at}/log").collect()))

    record_wiki(wiki_rows(0, 10, 1), folder, 0)
    run()
    assert state() == ({i: f"t{i} 2024-02-01 00:{i:02}:00" for i in range(10)}, [(0, "added", 10)])
    record_wiki(wiki_rows(7, 13, 2), folder, 10)
    real, calls = tables.replace_all, []

    def lost(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost before the version")
        out = real(*a, **k)
        if len(calls) == 2:
            raise RuntimeError("lost behind the version, before the stream notes it")
        return out

    monkeypatch.setattr(tables, "replace_all", lost)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    want = {i: f"t{i} 2024-02-0{1 if i < 7 else 2} 00:{i:02}:00" for i in range(13)}
    assert state() == (want, [(0, "added", 10), (1, "added", 3), (1, "updated", 3)]) and len(calls) == 2
    record_wiki(wiki_rows(0, 2, 3), folder, 16)
    run(F.col("page_id") == 1)
    rows, log = state()
    assert 1 not in rows and rows[0] == "t0 2024-02-03 00:00:00" and log[-2:] == [(2, "excluded", 1), (2, "updated", 1)]
    run()
    assert state() == (rows, log)  # nothing new, no batch


def test_versions_replace_delete_backup_restore(spark, tmp_path):
    path, root = str(tmp_path / "t"), str(tmp_path / "b")
    assert tables.version(spark, path) is None and tables.backups(spark, root) == []
    tables.replace(spark.range(5), path)
    tables.replace(tables.current(spark, path).withColumn("id", F.col("id") * 2), path)  # read from itself
    tables.delete(spark, path, F.when(F.col("id") == 0, F.lit(None)).otherwise(F.col("id") > 5))
    assert sorted(r.id for r in tables.current(spark, path).collect()) == [0, 2, 4]  # null deletes nothing
    tables.append_version(spark.createDataFrame([(9, "x")], "id long, v string").select("id"), path)
    for i in range(3):
        tables.backup(tables.current(spark, path), root, f"2024-0{i + 1}", limit=2 if i == 2 else None)
    assert tables.prune(spark, root, 2) == ["2024-01"] and tables.backups(spark, root) == ["2024-03", "2024-02"]
    tables.restore(spark, root, path, "2024-02")
    assert sorted(r.id for r in tables.current(spark, path).collect()) == [0, 2, 4, 9]


def test_a_crash_before_the_pointer_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace(spark.range(3), path)

    class Broken(Exception):
        pass

    def broken(*_):
        raise Broken

    monkeypatch.setattr(tables, "_files", broken)
    with pytest.raises(Broken):
        tables.replace(spark.range(9), path)
    monkeypatch.undo()
    assert tables.current(spark, path).count() == 3
    tables.replace(spark.range(4), path)
    assert tables.current(spark, path).count() == 4


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace(spark.range(3), path)
    was = tables.version
    monkeypatch.setattr(tables, "version", lambda s, p: 0 if p == path else was(s, p))  # both start from version 0
    assert tables.replace(spark.range(4), path) == 1
    monkeypatch.undo()
    stale = iter([0])  # the base is read before the other writer's version, then as it is
    monkeypatch.setattr(tables, "version", lambda s, p: next(stale, None) if (n := was(s, p)) is None else next(stale, n))
    with pytest.raises(tables.Conflict):
        tables.replace(spark.range(9), path)
    monkeypatch.undo()
    assert tables.current(spark, path).count() == 4 and tables.replace(spark.range(5), path) == 2 and tables.current(spark, path).count() == 5
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2  # older versions and the loser's folder are gone


def test_json_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None)], "id long, t string")
    tables.write_json(df, str(tmp_path / "j"))
    tables.write_csv(df.filter("id = 1"), str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_json(spark, str(tmp_path / "j"), "id long, t string").collect())) == [(1, 'a "b", c\nd'), (2, None)]
    assert tuple(tables.read_csv(spark, str(tmp_path / "c"), "id long, t string").first()) == (1, 'a "b", c\nd')
    assert tables.read_files(spark, str(tmp_path / "j"), "*.json").count() >= 1


def test_progress_goes_on_where_it_broke_off(spark, tmp_path):
    progress, done = incremental.Progress(spark, str(tmp_path / "p")), []
    batches = [(str(i), spark.range(i, i + 2)) for i in range(4)]

    def apply(rows):
        first = rows.first().id
        if first == 2 and 2 not in done:
            done.append(2)
            raise RuntimeError("lost")
        done.append(first)

    with pytest.raises(RuntimeError):
        progress.run(batches, apply)
    assert incremental.Progress(spark, str(tmp_path / "p")).run(batches, apply) == ["2", "3"] and done == [0, 1, 2, 2, 3]


@pytest.mark.parametrize(("policy", "kept"), [("lru", {"a", "c"}), ("fifo", {"b", "c"}), ("lfu", {"a", "c"})])
def test_caches_evict_by_policy_size_and_age(policy, kept):
    now = [0.0]
    c = caches.Cache(most=2, seconds=10, policy=policy, clock=lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1 and c.get("z", 0) == 0
    c.put("c", 3)
    assert set(c.entries) == kept and c.evicted == 1
    now[0] = 10
    assert c.get("c") is None and c.drop_expired() == 1 and c.stats()["hit_rate"] == 1 / 3 and c.stats()["expired"] == 2
    by_size = caches.Cache(most=9, most_bytes=10, policy=policy, clock=lambda: now[0])
    by_size.put("x", 1, 6)
    by_size.put("y", 1, 6)
    by_size.put("big", 1, 11)
    assert set(by_size.entries) == {"y"} and by_size.bytes == 6
    assert caches.cached(by_size, "y", lambda: 5) == 1 and caches.cached(by_size, "n", lambda: 5) == 5
    with pytest.raises(ValueError):
        caches.Cache(policy="none")
