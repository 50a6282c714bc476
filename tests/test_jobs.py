"""Commits, locks, and jobs that call a service: what happens when writers meet, runs die, and services fail."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from glossweave import model
from glossweave.plans import gaps, stories, waves
from glossweave.sources import commits
from glossweave.sources.snapshot import Conflict, SnapshotTable


def _ids(table, **more):
    return sorted(r.id for r in table.read(**more).collect())


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = (SnapshotTable(spark, f"{tmp_path}/t", "id bigint, k string", "k") for _ in range(2))
    one.write(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, k string"))
    mine, theirs = one.read(), two.read()
    assert one.write(mine.where("id = 1")) == 2
    with pytest.raises(Conflict):
        two.write(theirs.where("id = 2"))
    assert _ids(one) == [1] and two.write(two.read().where("id > 1")) == 3 and _ids(one) == []


def test_writers_of_one_version_at_the_same_time(spark, tmp_path):
    tables = [SnapshotTable(spark, f"{tmp_path}/t", "id bigint") for _ in range(6)]
    tables[0].write(spark.range(0))
    for t in tables:
        t.read()
    outcome, start = [], threading.Barrier(len(tables))

    def write(i):
        start.wait()
        try:
            outcome.append(tables[i].write(spark.range(i, i + 1)))
        except Conflict:
            outcome.append("conflict")

    threads = [threading.Thread(target=write, args=(i,)) for i in range(len(tables))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, outcome)) == ["2", *["conflict"] * 5] and len(_ids(tables[0])) == 1


def test_a_partition_is_replaced_alone(spark, tmp_path):
    kinds = "id bigint, k string"
    table, other = (SnapshotTable(spark, f"{tmp_path}/t", kinds, "k") for _ in range(2))
    table.write(spark.createDataFrame([(1, "a/b"), (2, "c"), (3, None), (4, ""), (5, "d")], kinds))
    before = table.folders()
    assert set(before) == {"pa/b", "pc", "n", "p", "pd"}
    first, second = table.read(parts=["pc"]), other.read(parts=["n"])
    assert [r.id for r in first.collect()] == [2] and [r.id for r in second.collect()] == [3]
    assert table.replace(spark.createDataFrame([(20, "c")], kinds)) == 2
    # Another partition of the same base: no conflict, and the first writer's change stays.
    assert other.replace(spark.createDataFrame([(30, None)], kinds), ["pd"]) == 3
    assert _ids(table) == [1, 4, 20, 30]
    after = table.folders()
    assert after["pa/b"] == before["pa/b"] and after["p"] == before["p"] and "pd" not in after
    assert sorted(r.id for r in table.read(version=1).collect()) == [1, 2, 3, 4, 5]
    # The same partition of the same base is one.
    table.read(), other.read()
    table.replace(spark.createDataFrame([(21, "c")], kinds))
    with pytest.raises(Conflict):
        other.replace(spark.createDataFrame([(22, "c")], kinds))
    assert _ids(table) == [1, 4, 21, 30]


def test_old_versions_go(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t", "id bigint, k string", "k", buckets=4)
    table.write(spark.range(40).withColumn("k", F.col("id").cast("string")))
    assert set(table.folders()) == {"p0", "p1", "p2", "p3"}
    for _ in range(4):
        table.replace(table.read(parts=["p1"]))
    assert table.vacuum() == 0
    assert table.vacuum(keep=2, seconds=-5) == 3 + 2 + 1  # three versions, data that only they needed, and the partition of the first one that was replaced
    assert sorted(os.listdir(f"{tmp_path}/t/versions")) == [commits.number(4), commits.number(5)]
    assert len(_ids(table)) == len(_ids(table, version=4)) == 40


def test_one_run_at_a_time(spark, tmp_path):
    clock = [100.0]
    first, second = (commits.RunLock(spark, f"{tmp_path}/lock", m, 60, lambda: clock[0]) for m in ("sync", "fill"))
    with first:
        with pytest.raises(commits.Busy, match="sync is running"):
            second.acquire()
        clock[0] += 50
        first.renew()
        clock[0] += 50
        with pytest.raises(commits.Busy):
            second.acquire()
    with second:
        clock[0] += 61  # its lease is over, as if its driver had died
        with first, pytest.raises(commits.Busy, match="sync took over"):
            second.renew()
    assert len(os.listdir(f"{tmp_path}/lock")) == 1


def _tables(spark, folder, n_stories, n_lines, parts="event_id"):
    made = stories.Tables(*(SnapshotTable(spark, f"{folder}/{n}", schema, parts) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    made.stories.write(spark.createDataFrame([(i, "jp_pending", "1.0", 1) for i in range(1, n_stories + 1)], model.STORIES))
    made.episodes.write(spark.createDataFrame([(i, "1", "s", "", "cn", 0) for i in range(1, n_stories + 1)], model.EPISODES))
    made.lines.write(spark.createDataFrame([(i, "1", f"k{i}.{j}", "", "unknown", "", j) for i in range(1, n_stories + 1) for j in range(n_lines)], model.LINES))
    return made


def Service(path, fails="", slow=0.0):
    """A service that notes every text it is asked for in a file, as it is called by worker processes; its class goes to them by value."""
    path = str(path)

    class Asked:
        def __call__(self, texts):
            time.sleep(slow)
            with open(path, "a") as out:
                out.write(json.dumps(texts) + "\n")
            if fails and any(t.startswith(fails) for t in texts):
                raise OSError("down")
            return [t.upper() for t in texts]

        def asked(self):
            return [t for line in open(path) for t in json.loads(line)] if os.path.exists(path) else []

    return Asked()


def _left(tables):
    return sorted(r.jp_key for r in tables.lines.read().where("cn_text = ''").collect())


def test_a_run_after_one_that_died_asks_for_the_rest(spark, tmp_path, monkeypatch):
    tables = _tables(spark, tmp_path, 6, 4)
    service, waved = Service(tmp_path / "asked"), []

    def die(self):
        waved.append(1)
        if len(waved) == 2:
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits.RunLock, "renew", die)
        m.setattr(gaps, "_put", lambda *_: None)  # nothing reaches the tables, as if the driver had gone
        with pytest.raises(KeyboardInterrupt):
            gaps.fill_stories(tables.stories, tables.episodes, tables.lines, service, 5, size=2, settings=waves.Settings(wait=0, span=1, groups=3))
    before = service.asked()
    assert len(before) == 12 and len(_left(tables)) == 24
    totals = gaps.fill_stories(tables.stories, tables.episodes, tables.lines, service, 6, size=2, settings=waves.Settings(wait=0, groups=3))
    assert totals == {"stories": 3, "candidates": 12, "translated": 12, "skipped": 0, "errors": 0}
    assert sorted(service.asked()) == sorted(f"k{i}.{j}" for i in range(1, 7) for j in range(4))  # each once
    assert _left(tables) == [] and {r.source for r in tables.stories.read().collect()} == {"llm"}
    assert gaps.fill_stories(tables.stories, tables.episodes, tables.lines, service, 7)["candidates"] == 0
    assert os.listdir(f"{tmp_path}/l-plans") == [] and os.listdir(f"{tmp_path}/l-log") == []


def test_a_failure_ends_its_story_only(spark, tmp_path):
    tables = _tables(spark, tmp_path, 3, 6)
    service = Service(tmp_path / "asked", fails="k2.2")
    before = tables.lines.folders()
    totals = gaps.fill_stories(tables.stories, tables.episodes, tables.lines, service, 5, size=2, tries=1)
    assert totals["errors"] == 1 and totals["translated"] == 14 and totals["shown"] == ["OSError: down"]
    assert _left(tables) == ["k2.2", "k2.3", "k2.4", "k2.5"] and "k2.4" not in service.asked()
    assert {r.event_id: r.source for r in tables.stories.read().collect()} == {1: "llm", 2: "jp_pending", 3: "llm"}
    before = tables.lines.folders()
    with pytest.raises(RuntimeError, match="story 2: OSError: down, after 0 texts"):
        gaps.fill_story(tables.stories, tables.episodes, tables.lines, 2, service, 6, size=2, tries=1)
    assert gaps.fill_story(tables.stories, tables.episodes, tables.lines, 2, Service(tmp_path / "well"), 6, size=2) == 4
    after = tables.lines.folders()
    assert _left(tables) == [] and {p for p in after if after[p] != before[p]} == {"p2"}


def test_automatic_runs_pause_after_a_failure(spark, tmp_path):
    tables = _tables(spark, tmp_path, 6, 4)
    clock = [1000.0]
    breaker = waves.SharedBreaker(spark, f"{tmp_path}/breaker", 600, lambda: clock[0])
    bad, well = Service(tmp_path / "bad", fails="k2"), Service(tmp_path / "well")
    settings = waves.Settings(groups=1)
    fill = lambda service, **more: gaps.fill_stories(tables.stories, tables.episodes, tables.lines, service, 5, size=2, settings=settings, service=breaker, **more)
    totals = fill(bad, automatic=True)
    assert totals["translated"] == 4 and totals["paused"] == "OSError: down"
    assert bad.asked() == ["k1.0", "k1.1", "k1.2", "k1.3", "k2.0", "k2.1"]  # one try, and nothing after it
    clock[0] += 599
    # Another session sees the pause.
    breaker = waves.SharedBreaker(spark, f"{tmp_path}/breaker", 600, lambda: clock[0])
    assert "down" in fill(well, automatic=True)["paused"] and well.asked() == []
    clock[0] += 2
    assert "paused" not in fill(well, automatic=True) and len(well.asked()) == 20 and _left(tables) == []


def test_a_success_by_hand_ends_the_pause(spark, tmp_path):
    tables = _tables(spark, tmp_path, 2, 2)
    breaker = waves.SharedBreaker(spark, f"{tmp_path}/breaker", 600, lambda: 1000.0)
    breaker.failed("down")
    assert breaker.closed() is not None
    gaps.fill_stories(tables.stories, tables.episodes, tables.lines, Service(tmp_path / "well"), 5, event_id=1, service=breaker)
    assert breaker.closed() is None and _left(tables) == ["k2.0", "k2.1"]


def test_sources_in_any_spelling_are_left_alone(spark, tmp_path):
    tables = _tables(spark, tmp_path, 4, 1)
    heads = spark.createDataFrame([(1, " Official_CN ", "1", 1), (2, "HUMAN", "1", 1), (3, "Pinned", "1", 1), (4, "other", "1", 1)], model.STORIES)
    tables.stories.read()
    tables.stories.write(heads)
    service = Service(tmp_path / "asked")
    gaps.fill_stories(tables.stories, tables.episodes, tables.lines, service, 5)
    assert service.asked() == ["k4.0"]


def test_progress_rises_while_a_job_runs(spark, tmp_path):
    tables = _tables(spark, tmp_path, 4, 4)
    told = []
    publish = lambda *x: told.append((*x, time.monotonic()))
    gaps.fill_stories(tables.stories, tables.episodes, tables.lines, Service(tmp_path / "asked", slow=0.05), 5, size=2, settings=waves.Settings(groups=2), publish=publish)
    done = [n for stage, _, n, total, _ in told if stage == "stories" and total == 16]
    assert done == sorted(done) and done[0] == 0 and done[-1] == 16 and 8 in done
    assert told[-1][-1] > told[0][-1]


def test_an_edit_that_came_while_a_fill_ran_stays(spark, tmp_path):
    tables = _tables(spark, tmp_path, 2, 3)
    other, edited = SnapshotTable(spark, f"{tmp_path}/l", model.LINES, "event_id"), []

    def edit(*_):
        if not edited:
            at = F.col("jp_key") == "k1.1"
            other.replace(other.read(parts=["p1"]).withColumns({"cn_text": F.when(at, "by hand").otherwise(F.col("cn_text")), "source": F.when(at, "human").otherwise(F.col("source"))}))
            edited.append(1)

    gaps.fill_stories(tables.stories, tables.episodes, tables.lines, Service(tmp_path / "asked"), 5, publish=edit)
    assert {r.jp_key: (r.cn_text, r.source) for r in tables.lines.read().where("event_id = 1").collect()} == {"k1.0": ("K1.0", "llm"), "k1.1": ("by hand", "human"), "k1.2": ("K1.2", "llm")}


def test_a_wave_of_many_groups_is_a_few_tasks(spark, tmp_path):
    """A wave takes as many tasks as there are cores to run them, a task holds a batch and not its group, and a failure ends its own group only."""
    size, path = 4, str(tmp_path / "asked")

    def translate(texts):
        with open(path, "a") as out:
            out.write(json.dumps(texts) + "\n")
        if "g7.9" in texts:
            raise OSError("down")
        return [t.upper() for t in texts]

    keys = spark.range(200).selectExpr("id event_id", "explode(sequence(0, if(id < 20, 13, 1))) item").selectExpr("event_id", "'1' episode_no", "'talk' kind", "concat('g', event_id, '.', item) jp", "item")
    plan = keys.selectExpr("*", "event_id group_no", f"cast(item div {size} as int) batch_no", f"cast(item % {size} + 1 as int) item_no").drop("item")
    plan.write.parquet(f"{tmp_path}/plan")
    log = waves.BatchLog(spark, f"{tmp_path}/log", gaps._STORY_LOG, gaps._STORY_KEY)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        outcome, run = waves.ask_all(spark.read.parquet(f"{tmp_path}/plan"), log, translate, waves.Settings(tries=1, span=1 << 20, groups=1 << 20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {i: [f"g{i}.{j}" for j in range(14 if i < 20 else 2)] for i in range(200)}
    assert sorted(map(tuple, map(json.loads, open(path)))) == sorted(tuple(t[k : k + size]) for i, t in texts.items() for k in range(0, len(t), size) if (i, k) != (7, 12))
    assert (outcome.candidates, outcome.translated, outcome.groups, outcome.errors, outcome.shown) == (640, 640 - 6, 200, 1, ["OSError: down"])
    assert {r.jp: r.cn_text for r in log.read().collect()} == {x: x.upper() for i, t in texts.items() for x in (t[:8] if i == 7 else t)}
    wave = f"{tmp_path}/log/{run}/00000000"
    assert 0 < sum(n.endswith(".parquet") for n in os.listdir(wave)) <= waves.TASKS_A_CORE * spark.sparkContext.defaultParallelism


def test_a_locked_table_is_not_filled(spark, tmp_path):
    tables = _tables(spark, tmp_path, 1, 1)
    with tables.lock("sync stories"), pytest.raises(commits.Busy, match="sync stories is running"):
        gaps.fill_stories(tables.stories, tables.episodes, tables.lines, Service(tmp_path / "asked"), 5)


# --- the story walk, and the source that it reads


def _listed(spark, ids):
    rows = [(i, json.dumps({"eventId": i, "assetbundleName": f"a{i}", "eventStoryEpisodes": [{"episodeNo": 1, "scenarioId": f"s{i}", "title": f"t{i}"}]})) for i in ids]
    return spark.createDataFrame(rows, "ord bigint, text string").select("ord", F.parse_json("text").alias("doc"))


def test_nothing_is_fetched_beyond_the_wave_of_the_stop(spark, tmp_path):
    from glossweave.sources import transport

    asked = f"{tmp_path}/asked"

    def get(url):
        with open(asked, "a") as out:
            out.write(url + "\n")
        edition, event = url.split("/")
        if url == "target/4":
            raise OSError("http 404")
        return json.dumps({"TalkData": [{"Body": f"{edition} {event}", "WindowDisplayName": ""}] * (url != "target/6")})

    spark.dataSource.register(transport.source("walk_test", get, transport.whole_talk, again=0))
    tables = stories.Tables(*(SnapshotTable(spark, f"{tmp_path}/{n}", schema) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    tables.stories.write(spark.createDataFrame([(2, "official_cn", "1.0", 1), (3, "human", "1.0", 1)], model.STORIES))
    there = [1, 2, 3, 4, 5, 6, 9, 10, 11, 12]
    lists = _listed(spark, range(1, 15)), _listed(spark, there), spark.createDataFrame([(i,) for i in there], "event_id bigint")
    told = []
    fetch = transport.scenario_fetch(spark, "walk_test", lambda edition, event, _: [f"{edition}/{event}"])
    got = stories.walk_stories(tables, *lists, fetch, 7, wave=3, publish=lambda *x: told.append(x))
    # From 3 on: 3 is kept, 4 fails, 5 is found, 6 has no talk, 7 and 8 aren't there: the third miss in a row is in the second wave.
    urls = open(asked).read().split()
    assert {u for u in urls if u.startswith("target")} == {f"target/{i}" for i in (4, 5, 6)}
    assert got == {"official": 1, "pending": 9, "errors": "1 failed: event 4: no target scenario of episode 1"}
    assert {r.event_id: r.source for r in tables.stories.read().collect()} == {2: "official_cn", 3: "human", 5: "official_cn"} | {i: "jp_pending" for i in range(6, 15)}
    assert [(r.jp_key, r.cn_text) for r in tables.lines.read().where("event_id = 5").collect()] == [("source 5", "target 5")]
    assert told[0][0] == "stories" and os.listdir(f"{tmp_path}/l-landed") == []


def test_a_wave_that_was_stored_is_not_fetched_again(spark, tmp_path):
    tables = stories.Tables(*(SnapshotTable(spark, f"{tmp_path}/{n}", schema) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    lists = _listed(spark, range(1, 5)), _listed(spark, range(1, 5)), spark.createDataFrame([(i,) for i in range(1, 5)], "event_id bigint")
    asked = []

    def fetch(wanted, edition):
        ids = sorted(r.event_id for r in wanted.collect())
        asked.append((edition, ids))
        if len(asked) == 4:
            raise OSError("down")
        rows = [(i, "1", json.dumps({"TalkData": [{"Body": f"{edition} {i}"}]})) for i in ids]
        return spark.createDataFrame(rows, "event_id bigint, episode_no string, text string").select("event_id", "episode_no", F.parse_json("text").alias("doc"))

    with pytest.raises(OSError):
        stories.walk_stories(tables, *lists, fetch, 7, wave=2)
    assert stories.walk_stories(tables, *lists, fetch, 8, wave=2)["official"] == 2
    assert asked == [(e, ids) for ids in ([1, 2], [3, 4], [3, 4]) for e in ("source", "target")]
    assert tables.stories.read().count() == 4


def test_newer_stories_take_few_waves_whatever_their_number(spark, tmp_path):
    tables = stories.Tables(*(SnapshotTable(spark, f"{tmp_path}/{n}", schema) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    asked = []

    def fetch(wanted, edition):
        asked.append(sorted(r.event_id for r in wanted.collect()))
        rows = [(i, "1", json.dumps({"TalkData": [{"Body": f"{edition} {i}"}]}) if i % 9 else None) for i in asked[-1]]
        return spark.createDataFrame(rows, "event_id bigint, episode_no string, text string").select("event_id", "episode_no", F.parse_json("text").alias("doc"))

    got = stories.walk_stories(tables, _listed(spark, range(1, 41)), _listed(spark, []), spark.createDataFrame([], "event_id bigint"), fetch, 7, wave=1)
    assert len(asked) <= 6 and sorted(i for a in asked for i in a) == list(range(1, 41))  # each once; a wave for each story before
    assert got == {"official": 0, "pending": 40, "errors": "4 failed: event 18: no source scenario of episode 1; event 27: no source scenario of episode 1; event 36: no source scenario of episode 1; 1 more"}
    assert {r.event_id: r.source for r in tables.stories.read().collect()} == {i: "jp_pending" for i in range(1, 41)} and tables.lines.read().count() == 36
    assert os.listdir(f"{tmp_path}/l-landed") == []


def test_scenarios_of_a_wave_do_not_pass_through_the_driver(spark, monkeypatch):
    from glossweave.sources import transport

    spark.dataSource.register(transport.source("many_test", lambda url: json.dumps({"TalkData": [{"Body": url}]}), transport.whole_talk, again=0))
    wanted = spark.range(1, 301).selectExpr("id event_id", "'1/2' episode_no", "concat('s', id) scenario_id")
    with monkeypatch.context() as m:
        m.setattr(type(wanted), "collect", lambda self: pytest.fail("collected"))
        docs = transport.scenario_fetch(spark, "many_test", lambda edition, event, scenario: [f"{edition}/{event}/{scenario}"])(wanted, "source")
    got = docs.selectExpr("event_id", "episode_no", "variant_get(doc, '$.TalkData[0].Body', 'string') body").collect()
    assert sorted(map(tuple, got)) == [(i, "1/2", f"source/{i}/s{i}") for i in range(1, 301)]


def test_a_source_fetches_at_the_same_time_and_keeps_errors(spark, tmp_path):
    from glossweave.sources import transport

    times = f"{tmp_path}/times"

    def get(url):
        began = time.time()
        time.sleep(0.7)
        with open(times, "a") as out:
            out.write(f"{began} {time.time()}\n")
        if url == "lost":
            raise OSError("http 404")
        return f'[1, {{"u": "{url}"}}, "x", {{}}]'

    spark.dataSource.register(transport.source("slow_test", get, again=0))
    rows = transport.load(spark, "slow_test", [("a", ["u1"]), ("b", ["lost", "u2"]), ("c", ["lost"]), ("d", ["", "u4", "u4 "])], 4)
    assert rows.rdd.getNumPartitions() == 4 and transport.tasks(99) == 12 and transport.tasks(0) == 1
    landing = transport.Landing(spark, "slow_test", f"{tmp_path}/landed")
    stored = landing.land([("a", ["u1"]), ("b", ["lost", "u2"]), ("c", ["lost"]), ("d", ["", "u4", "u4 "])], 4)
    assert {r.key: (r.body is not None, r.error) for r in stored.collect()} == {"a": (True, None), "b": (True, None), "c": (False, "http 404"), "d": (True, None)}
    spans = sorted(tuple(map(float, line.split())) for line in open(times))
    assert len(spans) == 5 and any(b < end for (_, end), (b, _) in zip(spans, spans[1:], strict=False))
    assert [(r.key, r.ord) for r in transport.array_documents(stored.where("error is null")).orderBy("key", "ord").collect()] == [(k, i) for k in "abd" for i in (0, 1)]
    with pytest.raises(Exception, match="no JSON array: c: http 404"):
        transport.array_documents(stored).collect()
    assert transport.load(spark, "slow_test", []).count() == 0
    editions = landing.editions({"events": ["u1"], "cards": ["lost"]})
    assert list(editions) == ["events"] and editions["events"].count() == 2


# --- streams with state


def _wait(until, seconds=60):
    end = time.monotonic() + seconds
    while not until():
        assert time.monotonic() < end, "nothing came"
        time.sleep(0.2)


def test_a_burst_makes_one_rebuild_without_a_later_event(spark, tmp_path):
    from glossweave.streaming import refresh

    kinds = "k string, n bigint"
    put = lambda *rows: spark.createDataFrame(list(rows), kinds).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    put(("a", 1), ("a", 2), ("b", 3))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    fired = []
    writer = refresh.rebuilds(stream, "k", gap=3, refresh=8).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds")
    query = writer.foreachBatch(lambda rows, _: fired.extend((r.key, r.reason, r.changes) for r in rows.collect())).start()
    try:
        _wait(lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 0)
        put(("a", 4))
        _wait(lambda: sum(r == "change" for _, r, _ in fired) == 2)
        _wait(lambda: sum(r == "refresh" for _, r, _ in fired) >= 4)
    finally:
        query.stop()
    changes = sorted(f for f in fired if f[1] == "change")
    assert [k for k, _, _ in changes] in (["a", "b"], ["a", "a", "b"]) and sum(n for k, _, n in changes if k == "a") == 3
    assert {(k, n) for k, r, n in fired if r == "refresh"} == {("a", 0), ("b", 0)}


def test_version_changes_of_a_stream_in_batches(spark, tmp_path):
    from glossweave.streaming import refresh

    polls = [("s", 1, "1"), ("s", 2, "1"), ("s", 3, "2"), ("t", 1, "x"), ("s", 5, ""), ("s", 4, "3"), ("t", 2, "x"), ("s", 6, "2"), ("t", 3, "y"), ("t", 4, "y")]
    kinds = "source string, polled_at bigint, version string"
    for i in range(0, len(polls), 3):
        spark.createDataFrame(polls[i : i + 3], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = []
    listener = refresh.StreamProgress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        changes = refresh.version_changes_stream(stream)
        query = changes.writeStream.queryName("polls").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        _wait(lambda: told and told[-1][1] == "ended")
    finally:
        spark.streams.removeListener(listener)
    rows = lambda df: sorted(tuple(r) for r in df.select("source", "polled_at", "version", "previous").collect())
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(refresh.version_changes(spark.createDataFrame(polls, kinds)))
    batches = [x for x in told if x[1].startswith("batch")]
    assert len({x[1] for x in batches}) >= 4 and [x[2] for x in batches] == sorted(x[2] for x in batches) and max(x[2] for x in batches) == len(polls)


# --- files and imports


def test_files_from_many_tasks_are_byte_for_byte_those_of_one(spark, tmp_path, monkeypatch):
    import random

    from glossweave.sources import export

    rng = random.Random(2)
    odd = ["é", "<b>&", " ", '"q"', "\\", "漢", "a\nb", "z", "Z", "", "\U0001f600"]
    rows = {("cards", rng.choice(["f", "g", "é"]), rng.choice(odd) + str(i)): (rng.choice(odd), rng.choice(["cn", "llm"]), [str(i)] * (i % 3)) for i in range(400)}
    rows |= {("music", "f", ""): ("x", "cn", []), ("other", "f", "k"): ("no category", "cn", [])}
    entries = spark.createDataFrame([(*k, *v, 1, "u") for k, v in rows.items()], model.ENTRIES)
    monkeypatch.setattr(export, "PIECE", 200)
    pieces = export.category_pieces(entries)
    assert pieces.where("path = 'translation/cards.json'").count() > 20
    assert export.write_files(pieces, str(tmp_path / "out")) == 2 * len(model.CATEGORIES)
    whole = {r.path: r.body for r in export.category_files(entries).collect()}
    for c in model.CATEGORIES:
        flat, full = {}, {}
        for (_, f, k), (t, s, ids) in sorted(((k, v) for k, v in rows.items() if k[0] == c), key=lambda x: (x[0][1].encode(), x[0][2].encode())):
            flat.setdefault(f, {})[k] = t
            full.setdefault(f, {})[k] = {"text": t, "source": s} | ({"ids": ids} if ids else {})
        for name, want in ((f"translation/{c}.json", flat), (f"translation/{c}.full.json", full)):
            assert (tmp_path / "out" / name).read_bytes().decode() == export.dumps(want, True) == whole[name]
    assert export.write_files(pieces, (tmp_path / "out").as_uri()) == 2 * len(model.CATEGORIES)
    assert not [p for p in (tmp_path / "out").rglob("*.part")]


def test_a_folder_is_imported_with_a_report(spark, tmp_path):
    from glossweave.plans import imports

    top = tmp_path / "in"
    (top / "eventStory").mkdir(parents=True)
    (top / "events.json").write_text(json.dumps({"name": {"e": "E"}}))
    (top / "cards.full.json").write_text(json.dumps({"prefix": {"q": "{'text': 'q', 'source': 'cn', 'ids': ['1']}", "r": {"text": "R", "source": "human", "ids": ["2"]}}}))
    (top / "cards.json").write_text(json.dumps({"prefix": {"q": "Q"}}))
    (top / "music.json").write_text("{}")
    (top / "unknown.json").write_text("broken")
    story_doc = {"meta": {"source": "cn", "version": "2", "last_updated": 3}, "episodes": {"1": {"scenarioId": "x", "title": "t", "talkData": {"a": "1"}}}}
    (top / "eventStory/event_5.json").write_text(json.dumps(story_doc))
    (top / "eventStory/event_6.json").write_text("broken")
    entries = SnapshotTable(spark, f"{tmp_path}/e", model.ENTRIES, "category")
    row = lambda c, k: (c, "f", k, "old", "llm", [], 1, "u")
    entries.write(spark.createDataFrame([row("cards", "gone"), row("music", "gone"), row("units", "stays")], model.ENTRIES))
    before = entries.folders()
    tables = _tables(spark, tmp_path, 2, 1)
    report = imports.import_folder(entries, tables, spark, str(top), 9)
    assert report == imports.Report(3, 3, 1, 2, ["cards/prefix: q recovered", "event_6.json: no episodes, or not JSON"])
    assert imports.summary(spark, report).first().entries == 3
    assert {(r.category, r.jp_key): (r.cn_text, r.source, r.updated_at) for r in entries.read().collect()} == {("units", "stays"): ("old", "llm", 1), ("events", "e"): ("E", "unknown", 9), ("cards", "q"): ("Q", "cn", 9), ("cards", "r"): ("R", "human", 9)}
    assert entries.folders()["punits"] == before["punits"]
    assert {r.event_id: r.source for r in tables.stories.read().collect()} == {1: "jp_pending", 2: "jp_pending", 5: "cn"}
    with pytest.raises(ValueError, match="no category document"):
        imports.import_folder(entries, tables, spark, f"{top}/eventStory", 9)


def test_the_sync_job_reads_through_the_source(spark, tmp_path):
    """Both editions' documents come from a transport, once each; a category whose document is lost is skipped."""
    from glossweave.plans import sync
    from glossweave.sources import transport

    asked = f"{tmp_path}/asked"
    there = {"source/events": [{"id": 1, "name": "a"}, "x", {"id": 2, "name": "b"}], "target/events": [{"id": 1, "name": "A"}], "source/skills": [{"id": 1, "description": "d"}]}

    def get(url):
        with open(asked, "a") as out:
            out.write(url + "\n")
        if url not in there:
            raise OSError("http 404")
        return json.dumps(there[url])

    spark.dataSource.register(transport.source("sync_test", get, again=0))
    landing = transport.Landing(spark, "sync_test", f"{tmp_path}/landed")
    editions = [landing.editions({n: [f"{edition}/{n}"] for n in ("events", "skills", "virtualLives")}) for edition in ("source", "target")]
    table = SnapshotTable(spark, f"{tmp_path}/e", model.ENTRIES, "category")
    done = sync.sync(table, *editions, now=4)
    assert done["changed"] == {"events": 2} and {"skills", "virtualLive"} <= set(done["skipped"])
    assert {r.jp_key: (r.cn_text, r.ids) for r in table.read().collect()} == {"a": ("A", ["1"]), "b": ("", ["2"])}
    assert sorted(open(asked).read().split()) == sorted(f"{e}/{n}" for e in ("source", "target") for n in ("events", "skills", "virtualLives"))
