from seamark.operators import bm25
from seamark.streaming import jobs, ttl, watch


def drain(query):
    query.processAllAvailable()
    query.stop()


def memory(spark, df, name, mode):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()


EVENTS = [(1, "2024-01-01 00:00:01", 1, "view", 2.0), (2, "2024-01-01 00:00:20", 1, "view", 4.0), (3, "2024-01-01 00:00:40", 2, "view", 6.0), (4, "2024-01-01 02:00:00", 1, "click", 1.0), (5, "2024-01-01 00:00:21", 1, "view", 9.0)]


def source(spark, folder):
    rows = spark.createDataFrame(EVENTS, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "to_timestamp(t) AS ts", "user_id", "event_type", "value")
    for k in range(1, 6):
        rows.where(f"event_id = {k}").coalesce(1).write.mode("append").parquet(folder)
    return jobs.event_stream(spark, folder, rows.schema)


def test_windows_sessions_and_averages(spark, tmp_path):
    events = source(spark, str(tmp_path / "e"))
    drain(memory(spark, jobs.sampled(events), "s", "update"))
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in spark.table("s").orderBy("n").collect()}
    assert got["2024-01-01 00:00:00", "view"] >= 2
    drain(memory(spark, jobs.session_counts(events), "w", "append"))
    drain(memory(spark, jobs.moving_averages(events), "m", "update"))
    last = spark.table("m").where("event_type = 'view'").orderBy("n").collect()[-1]
    assert last["n"] == 4


def test_first_of_a_key_within_a_time(spark, tmp_path):
    events = source(spark, str(tmp_path / "e"))
    drain(memory(spark, jobs.once(events, ["user_id", "event_type"]), "o", "append"))
    assert {(r["user_id"], r["event_type"]) for r in spark.table("o").collect()} == {(1, "view"), (2, "view"), (1, "click")}


def changes(spark, rows):
    return spark.createDataFrame(rows, watch.CHANGES).coalesce(1)


def follow(spark, files, index, checkpoint):
    index.follow(spark.readStream.schema(watch.CHANGES).parquet(files), checkpoint).awaitTermination()


def terms_of(index):
    return {(r["term"], r["doc_id"], r["tf"]) for r in index.index().postings.collect()}


def test_watched_index(spark, tmp_path):
    files, index, checkpoint = str(tmp_path / "f"), watch.WatchedIndex(spark, str(tmp_path / "i")), str(tmp_path / "c")
    changes(spark, [(1, "a", "alpha beta", 1, False), (2, "b", "gamma", 1, False), (3, "c", "omega omega", 1, False)]).write.parquet(files)
    follow(spark, files, index, checkpoint)
    assert terms_of(index) == {("alpha", 1, 1), ("beta", 1, 1), ("gamma", 2, 1), ("omega", 3, 2)}
    # Changed, deleted, and both in one batch with versions in disorder; the stream starts again where it was.
    changes(spark, [(1, "a", "delta", 3, False), (1, "a", "wrong", 2, False), (2, "b", None, 2, True)]).write.mode("append").parquet(files)
    follow(spark, files, index, checkpoint)
    assert terms_of(index) == {("delta", 1, 1), ("omega", 3, 2)}
    q = spark.createDataFrame([(0, "omega delta")], "query_id long, query string")
    assert {r["doc_id"] for r in bm25.ranked(index.index(), q, min_score=1e-9).collect()} == set()  # both are in half of two documents
    # A late old version changes nothing; a deleted document comes back.
    changes(spark, [(3, "c", "late", 0, False), (2, "b", "zeta", 5, False)]).write.mode("append").parquet(files)
    follow(spark, files, index, checkpoint)
    assert terms_of(index) == {("delta", 1, 1), ("omega", 3, 2), ("zeta", 2, 1)}
    # A batch that is repeated after a failure replaces itself.
    before = index.folders()
    index.take(changes(spark, [(3, "c", "late", 0, False), (2, "b", "zeta", 5, False)]), 2)
    assert index.folders() == before and terms_of(index) == {("delta", 1, 1), ("omega", 3, 2), ("zeta", 2, 1)}
    assert index.index().corpus.first()["n"] == 3 and index.index().documents.count() == 3


def test_watched_index_puts_folders_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "FOLDERS", 3)
    index = watch.WatchedIndex(spark, str(tmp_path / "i"))
    for n in range(5):
        index.take(changes(spark, [(n, "p/a", f"word{n} common", 1, False), (0, "p/a", f"zero{n}", 2 + n, n == 4)]), n)
        index.compact()
    assert len(index.folders()) < 4 and any(f[0].startswith("merged") for f in index.folders())
    assert terms_of(index) == {(w, n, 1) for n in range(1, 5) for w in (f"word{n}", "common")}
    df = {r["term"]: r["df"] for r in index.index().terms.collect()}
    assert df["common"] == 4


def test_changed_files(spark):
    listing = lambda rows: spark.createDataFrame(rows, "file_path string, size long, modified long")
    got = watch.changed_files(listing([("same", 1, 1), ("new", 1, 2), ("grown", 2, 1)]), listing([("same", 1, 1), ("grown", 1, 1), ("gone", 3, 1)])).collect()
    assert {(r["file_path"], r["deleted"]) for r in got} == {("new", False), ("grown", False), ("gone", True)}


def test_entries_expire(spark, tmp_path):
    """Seconds after midnight of the uses of two keys; entries live 100 seconds."""
    at = [(1, 0, "a"), (2, 50, "a"), (3, 99, "b"), (4, 100, "a"), (5, 199, "a"), (6, 300, "a"), (7, 300, "a"), (8, 2000, "b"), (9, 1960, "a")]
    rows = spark.createDataFrame(at, "event_id long, s long, name string").selectExpr("event_id", "timestamp_seconds(1704067200 + s) AS ts", "name")
    folder = str(tmp_path / "e")
    (tmp_path / "e").mkdir()
    stream = jobs.event_stream(spark, folder, rows.schema, per_trigger=1)

    def run(some):
        some.coalesce(1).write.mode("append").parquet(folder)
        with jobs.rocksdb(spark):
            return {r["event_id"] for r in jobs.drained(ttl.computed(stream, ["name"], {"cache": 100}, "1 minute"), str(tmp_path / "out")).collect()}

    assert run(rows.where("event_id <= 5")) == {1, 3, 4}
    assert run(rows.where("event_id > 5")) == {1, 3, 4, 6, 8, 9}
    # Too late by more than a minute: dropped.  Late, but in time: the entry made after it is found.
    late = spark.createDataFrame([(10, 500, "a"), (11, 1950, "a"), (12, 1955, "c")], "event_id long, s long, name string").selectExpr("event_id", "timestamp_seconds(1704067200 + s) AS ts", "name")
    assert run(late) == {1, 3, 4, 6, 8, 9, 12}


def test_windows_leave_the_state(spark, tmp_path):
    events = source(spark, str(tmp_path / "e"))
    got = jobs.drained(jobs.sampled(events, late="1 second"), str(tmp_path / "d"))
    # The last window isn't over, so it isn't there; later runs don't repeat what is.
    assert str(got.agg({"start": "max"}).first()[0]) < "2024-01-01 02:00:00"
    n = got.count()
    jobs.drained(jobs.sampled(events, late="1 second"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d" / "result")).count() == n


def test_moving_average_of_more_values_than_a_task_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "LAST_VALUES", 300)
    values = [(i, f"2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", 1, "view", float(i % 17)) for i in range(2000)]
    rows = spark.createDataFrame(values, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "to_timestamp(t) AS ts", "user_id", "event_type", "value")
    rows.repartition(3).write.parquet(str(tmp_path / "e"))
    drain(memory(spark, jobs.moving_averages(jobs.event_stream(spark, str(tmp_path / "e"), rows.schema, None)), "ma", "update"))
    want = 0.0
    for i, v in enumerate(x[4] for x in values):
        want = v if i == 0 else 0.9 * want + 0.1 * v
    got = spark.table("ma").first()
    assert got["n"] == 2000 and abs(got["ema"] - want) < 1e-9
