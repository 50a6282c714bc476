"""Merges, stories, extraction, fill, readers and exports against worked examples."""

import json

import pytest
from pyspark.sql import functions as F

from glossweave import model
from glossweave.operators import entries as entry_ops
from glossweave.operators import extract, fill, merge, rollup, search_index, story, verify
from glossweave.plans import gaps, sync
from glossweave.sources import export, fetch, readers
from glossweave.sources.snapshot import SnapshotTable
from glossweave.streaming import refresh


def entries(spark, *rows):
    return spark.createDataFrame([("cards", "f", k, t, s, list(i), 1, "u") for k, t, s, i in rows], model.ENTRIES)


def key_rows(spark, kind, *rows):
    return spark.createDataFrame([("cards", "f", k, v) for k, v in rows], f"category string, field string, jp_key string, {kind}")


MERGE = [
    # stored (text, source, ids), incoming text, new ids, then text, source, ids, action
    (None, "A", ["1"], "A", "cn", ["1"], "insert"),
    (None, "", ["1"], "", "unknown", ["1"], "insert"),
    (("P", "pinned", ["1"]), "A", ["2"], "P", "pinned", ["1", "2"], "update"),
    (("P", "pinned", ["1"]), "A", ["1"], "P", "pinned", ["1"], "keep"),
    (("H", "human", []), "A", [], "A", "cn", [], "update"),
    (("H", "human", []), "", [], "H", "human", [], "keep"),
    (("", "llm", []), "", [], "", "unknown", [], "update"),
    (("", "pinned", []), "", [], "", "unknown", [], "update"),
    (("A", "cn", ["2", "1"]), "A", ["1", "3"], "A", "cn", ["2", "1", "3"], "update"),
    (("L", "llm", []), "A", [], "A", "cn", [], "update"),
    (("x", "llm", ["1"]), None, ["2"], "x", "llm", ["1", "2"], "trace"),
    (("x", "llm", ["1"]), None, None, "x", "llm", ["1"], "keep"),
]


def test_sync_merge(spark):
    stored = entries(spark, *((f"k{i}", *m[0]) for i, m in enumerate(MERGE) if m[0]))
    pairs = key_rows(spark, "cn_text string", *((f"k{i}", m[1]) for i, m in enumerate(MERGE) if m[1] is not None))
    traces = key_rows(spark, "ids array<string>", *((f"k{i}", m[2]) for i, m in enumerate(MERGE) if m[2]), ("unstored", ["9"]))
    got = {r.jp_key: r for r in merge.sync_merge(stored, pairs, traces, now=9).collect()}
    assert set(got) == {f"k{i}" for i in range(len(MERGE))}
    for i, m in enumerate(MERGE):
        r = got[f"k{i}"]
        assert (r.cn_text, r.source, r.ids, r.action) == m[3:], m
        assert (r.updated_at, r.updated_by) == ((9, "cn-sync") if r.action in ("insert", "update") else (1, "u"))
    merged = merge.sync_merge(stored, pairs, traces, now=9)
    assert merge.count_changes(merged).first().changed == sum(m[6] != "keep" for m in MERGE)


def test_strict_precedence_spares_people(spark):
    stored = entries(spark, ("a", "H", "human", []), ("b", "L", "llm", []))
    pairs = key_rows(spark, "cn_text string", ("a", "A"), ("b", "B"))
    got = {r.jp_key: r.cn_text for r in merge.sync_merge(stored, pairs, key_rows(spark, "ids array<string>"), 1, strict_precedence=True).collect()}
    assert got == {"a": "H", "b": "B"}


def test_copy_field(spark):
    rows = [("mysekai", f, k, t, s, [], 1, "u") for f, k, t, s in [("tag", "a", "T", "cn"), ("flavorText", "a", "", "unknown"), ("tag", "b", "", "unknown"), ("flavorText", "b", "x", "llm"), ("tag", "c", "S", "cn"), ("flavorText", "c", "S", "cn"), ("tag", "d", "U", "cn")]]
    frame = spark.createDataFrame(rows, model.ENTRIES).withColumn("action", F.lit("keep"))
    out = merge.copy_field(frame)
    got = {(r.field, r.jp_key): (r.cn_text, r.source, r.copied) for r in out.collect()}
    assert got["flavorText", "a"] == ("T", "cn", True) and got["flavorText", "b"] == ("x", "llm", False)
    assert got["flavorText", "c"] == ("S", "cn", False) and len(got) == 7
    assert merge.count_changes(out).first().changed == 1


def test_fill_merge(spark):
    stored = entries(spark, *((s + t, t, s, []) for t, s in [("x", "pinned"), ("x", "human"), ("x", "cn"), ("", "unknown"), ("", "llm"), ("x", "llm"), ("x", "unknown"), ("x", "other")]))
    keys = [r.jp_key for r in stored.collect()]
    out = merge.fill_merge(stored, key_rows(spark, "cn_text string", *((k, "ai") for k in [*keys, "new"])), now=2)
    got = {r.jp_key: r.action for r in out.collect()}
    assert got == {"pinnedx": "skip", "humanx": "skip", "cnx": "skip", "otherx": "skip", "unknown": "update", "llm": "update", "llmx": "update", "unknownx": "update", "new": "insert"}
    assert tuple(merge.fill_counts(out).first()) == (5, 4)


def test_edit_upsert_and_replace(spark):
    stored = entries(spark, ("a", "x", "cn", []), ("b", "y", "cn", []))
    edits = spark.createDataFrame([("cards", "f", "a", "x", "cn", "me"), ("cards", "f", "c", "z", "human", "me")], "category string, field string, jp_key string, cn_text string, source string, updated_by string")
    assert {r.jp_key: r.action for r in merge.edit_merge(stored, edits, 3).collect()} == {"a": "noop", "b": "keep", "c": "ok"}
    a, b = (spark.createDataFrame(r, "key string, value string") for r in ([("k", "1"), ("l", "2")], [("k", "3"), ("m", "4")]))
    assert {tuple(r) for r in merge.upsert(a, b, ["key"]).collect()} == {("k", "3"), ("l", "2"), ("m", "4")}
    assert {tuple(r) for r in merge.insert_absent(a, b, ["key"]).collect()} == {("k", "1"), ("l", "2"), ("m", "4")}
    assert {tuple(r) for r in merge.replace_groups(a, b, "key").collect()} == {("k", "3"), ("l", "2"), ("m", "4")}


def docs(spark, *items):
    return extract.array_documents(spark.createDataFrame([(json.dumps(list(items)),)], "value string"))


def got_pairs(result):
    pairs, traces = result
    return {(r.field, r.jp_key): r.cn_text for r in pairs.collect()}, {(r.field, r.jp_key): r.ids for r in traces.collect()}


def test_extract_cards(spark):
    jp = docs(spark, {"id": 1, "prefix": " a ", "cardSkillName": "s", "gachaPhrase": "-"}, {"id": "2", "prefix": "a", "cardSkillName": "s", "gachaPhrase": "g"}, {"id": 0, "prefix": "zero"}, 7, {"id": 3, "prefix": 5})
    cn = docs(spark, {"id": 1, "prefix": "A"}, {"id": 1, "prefix": "AA", "cardSkillName": "s"}, {"id": 2, "prefix": ""}, {"id": 0, "prefix": "ZERO"})
    pairs, ids = got_pairs(extract.extract("cards", {"cards": jp}, {"cards": cn}))
    assert pairs == {("prefix", "a"): "", ("skillName", "s"): "", ("gachaPhrase", "g"): "", ("prefix", "zero"): ""}
    assert ids == {("prefix", "a"): ["1", "2"], ("skillName", "s"): ["1", "2"], ("gachaPhrase", "g"): ["2"]}


def test_extract_music_keeps_padding_in_pairs(spark):
    jp = docs(spark, {"id": 1, "title": "t ", "lyricist": "l", "composer": "-", "arranger": "l"})
    vocals = docs(spark, {"id": 0, "musicId": 4, "caption": "c"}, {"id": 5, "caption": "c"})
    pairs, ids = got_pairs(extract.extract("music", {"musics": jp, "musicVocals": vocals}, {}))
    assert pairs == {("title", "t "): "", ("artist", "l"): "", ("vocalCaption", "c"): ""}
    assert ids == {("title", "t"): ["1"], ("artist", "l"): ["1"], ("vocalCaption", "c"): ["4", "5"]}


def test_extract_others(spark):
    comic = extract.extract("comic", {"tips": docs(spark, {"id": 1, "title": "x"}, {"id": 2, "title": "y", "assetbundleName": "b"})}, {"tips": docs(spark, {"id": 2, "title": "Y"})})
    assert got_pairs(comic) == ({("title", "y"): "Y"}, {("title", "y"): ["2"]})
    units = extract.extract("units", {"unitProfiles": docs(spark, {"unit": "u", "unitName": "n", "profileSentence": "p"})}, {"unitProfiles": docs(spark, {"unit": "u", "unitName": "N"})})
    assert got_pairs(units) == ({("unitName", "n"): "N", ("profileSentence", "p"): ""}, {("unitName", "n"): ["u"], ("profileSentence", "p"): ["u"]})
    jp = docs(spark, {"id": 1, "name": "c", "designer": "-", "parts": {"hair": [{"assetbundleName": "x", "colorName": "red"}], "body": [{"assetbundleName": "x", "colorName": "blue"}, {"assetbundleName": "y", "colorName": "-"}]}})
    cn = docs(spark, {"id": 1, "name": "C", "parts": {"hair": [{"assetbundleName": "x", "colorName": "RED"}], "body": [{"assetbundleName": "x", "colorName": "old"}, {"assetbundleName": "x", "colorName": "BLUE"}]}})
    assert got_pairs(extract.extract("costumes", {"costumes": jp}, {"costumes": cn})) == ({("name", "c"): "C", ("colorName", "red"): "RED", ("colorName", "blue"): "BLUE"}, {("name", "c"): ["1"], ("colorName", "red"): ["1"], ("colorName", "blue"): ["1"]})
    assert set(extract.SPECS) == set(model.CATEGORIES)


def scenario(spark, *talk):
    doc = {"TalkData": [{"Body": b, "WindowDisplayName": n} for b, n in talk]}
    return spark.createDataFrame([(1, "1", json.dumps(doc))], "event_id bigint, episode_no string, value string").select("event_id", "episode_no", F.parse_json("value").alias("doc"))


def test_pairing_and_pending(spark):
    jp = scenario(spark, ("b1", "n1"), ("b2", "n1"), ("b1", ""))
    cn = scenario(spark, ("c1", "m1"), ("b2", "m1"))
    got = [(r.jp_key, r.cn_text, r.speaker_name) for r in story.pair_scenarios(jp, cn).orderBy("position").collect()]
    assert got == [("b1", "c1", "m1"), ("n1", "m1", "")]
    assert [(r.jp_key, r.speaker_name) for r in story.pending_lines(jp).orderBy("position").collect()] == [("b1", "n1"), ("n1", ""), ("b2", "n1")]
    heads = lambda t: spark.createDataFrame([(1, "10", "s", t), (1, "1", "s", "T"), (1, "2", "s", "")], "event_id bigint, episode_no string, scenario_id string, title string")
    eps, lines = story.build_official(heads("old"), heads("new"), story.pair_scenarios(jp, cn))
    assert [(r.episode_no, r.title, r.position) for r in eps.orderBy("position").collect()] == [("1", "", 0), ("10", "new", 1)]
    assert {r.source for r in lines.collect()} == {"cn"}
    eps, _ = story.build_pending(heads("old"), story.pending_lines(jp))
    assert [(r.episode_no, r.title) for r in eps.orderBy("position").collect()] == [("1", "T"), ("10", "old")]


def test_stories(spark):
    nested = "event_id bigint, source string, version string, last_updated bigint, episodes array<struct<episode_no string, scenario_id string, title string, title_source string, talk array<struct<jp_key string, cn_text string, source string, speaker_name string>>>>"
    talk = [("k1", "", None, "s"), ("k2", None, None, None), ("k3", "x", "human", None)]
    frame = spark.createDataFrame([(7, "llm", "", 0, [("2", "a", "T", "unknown", talk), ("10", "b", "U", "cn", [("z", "", "", "")])])], nested)
    stories, eps, lines = story.store_story(frame, now=5)
    assert tuple(stories.first()) == (7, "llm", "1.0", 5)
    assert {(r.jp_key, r.source, r.position) for r in lines.where("episode_no = '2'").collect()} == {("k1", "llm", 0), ("k3", "human", 2)}
    targets = [(r.episode_no, r.kind, r.jp) for r in story.untranslated_targets(eps, lines).orderBy("target_no").collect()]
    assert targets == [("2", "title", "T"), ("10", "talk", "z"), ("2", "talk", "k1")]
    assert rollup.story_summaries(stories, eps, lines).first().untranslated_count == 3
    states = rollup.sync_states(stories, eps, lines)
    assert states.first().preserve and states.first().is_llm
    ordered = story.ordered_detail(stories, eps, lines.union(lines.limit(1).withColumn("episode_no", F.lit("99"))))
    body = json.loads(export.story_files(ordered).first().body)
    assert list(body["episodes"]) == ["2", "10"] and list(body["episodes"]["2"]["talkData"]) == ["k1", "k3"]
    detail = {r.episode_no: r for r in story.map_detail(ordered).collect()}
    assert detail["2"].speaker_names == {"k1": "s"} and detail["10"].speaker_names is None
    shown = [r.key for r in story.display_rows(stories, eps, lines).orderBy("ord").collect()]
    assert shown == ["2|__title__|T", "2|k1", "2|k3", "10|__title__|U", "10|z"]
    s2, e2, l2 = story.promote(stories, eps, lines, 7, 8)
    assert {r.source for r in l2.collect()} == {"human"} and s2.first().last_updated == 8 and {r.title_source for r in e2.collect()} == {"human"}
    assert story.edit_line(eps, lines, 7, "2", "new", "", "k1")[1].where("jp_key = 'k1'").first().source == "human"
    with pytest.raises(LookupError):
        story.edit_line(eps, lines, 7, "3", "new", "cn")
    results = story.untranslated_targets(eps, lines).withColumn("cn_text", F.lit("done"))
    e3, l3 = story.apply_results(eps, lines, results)
    assert story.set_source(stories, e3, l3, 9, [7]).first().source == "llm"
    assert story.set_source(stories, eps, lines, 9, [7]).first().source == "jp_pending"


def test_streak(spark):
    outcome = {1: "keep", 2: "miss", 3: "miss", 4: "found", 5: "miss", 6: "error", 7: "miss", 8: "miss", 9: "found"}
    checks = spark.createDataFrame(list(outcome.items()), "event_id bigint, outcome string")
    walked = story.walk_streak(checks, 1)
    assert max(r.event_id for r in walked.collect()) == 8
    states = spark.createDataFrame([(1, True, False), (4, True, False)], "event_id bigint, is_official boolean, preserve boolean")
    assert sorted(r.event_id for r in story.fallback_events(checks, states, walked).collect()) == [5, 6, 7, 8, 9]
    short = story.walk_streak(checks.where("event_id < 8"), 1)
    assert story.fallback_events(checks, states, short).count() == 0 and short.count() == 7


def test_reorder(spark):
    lines = spark.createDataFrame([(1, "1", k, "", "", "", p) for p, k in enumerate("abcd")], model.LINES)
    wanted = spark.createDataFrame([(1, "1", ["c", "x", "a"])], "event_id bigint, episode_no string, keys array<string>")
    assert {r.jp_key: r.position for r in story.reorder_lines(lines, wanted).collect()} == {"c": 0, "a": 1, "b": 2, "d": 3}


def test_rollups(spark):
    rows = entries(spark, ("a", "", "odd", []), ("b", "", "cn", []), ("c", "", "llm", [])).union(spark.createDataFrame([("other", "f", "k", "", "cn", [], 1, "u")], model.ENTRIES))
    info = rollup.category_info(rows).collect()
    assert [(r.category, r.ordinal, [tuple(f) for f in r.fields]) for r in info] == [("cards", 0, [("f", 3, 1, 0, 0, 1, 1)])]
    assert [r.jp_key for r in entry_ops.by_rank(rows.where("category = 'cards'")).collect()][-1] == "b"
    with pytest.raises(ValueError):
        entry_ops.select_entries(rows, "nope", "f")
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "ord int, category string, detail string")
    assert rollup.skipped_categories(log).first().detail == "y"
    assert fill.candidate_counts(rows.where("category = 'cards'")).first().candidates == 2


def test_fill_calls(spark):
    tries = []

    def flaky(texts):
        tries.append(len(texts))
        if len(tries) == 1:
            raise OSError("down")
        return [t.upper() for t in texts[:-1]]

    assert fill.call(flaky, ["a", "b"], wait=0) == (["A", ""], "")
    assert fill.call(lambda t: [""] * len(t), ["a", "b", "c"], tries=2, wait=0)[1] == "0 of 3 texts came back"
    rows = spark.createDataFrame([("g", f"{i:02}") for i in range(5)], "grp string, jp string")
    out = fill.translated(fill.batches(rows, ["grp"], ["jp"], 2), lambda texts: [f"{len(texts)}{t}" for t in texts], ["grp"], "jp", wait=0)
    assert sorted(r.cn_text for r in out.collect()) == ["104", "200", "201", "202", "203"]


def test_resume(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t", "id bigint, done boolean")
    table.write(spark.range(4).withColumn("done", F.lit(False)))
    calls = []

    def step(part):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("down")
        ids = [r.id for r in part.collect()]
        table.write(table.read().withColumn("done", F.col("done") | F.col("id").isin(ids)))

    pending = lambda: table.read().where("not done").orderBy("id")
    with pytest.raises(OSError):
        list(fill.resumable(pending, step, 2))
    assert pending().count() == 2
    assert list(fill.resumable(pending, step, 2)) == [2]
    assert pending().count() == 0 and table.version() == 3


def test_readers_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    full = {"name": {"q": "{'text': 'q', 'source': 'cn', 'ids': ['1', '2']}", "r": {"text": "R & <b>", "source": "human", "ids": ["1"]}, "s": "{'text': 's'}"}}
    (tmp_path / "in/virtualLive.full.json").write_text(json.dumps(full))
    (tmp_path / "in/virtualLive.json").write_text(json.dumps({"name": {"q": "Q"}}))
    (tmp_path / "in/events.json").write_text(json.dumps({"name": {"e": "E"}}))
    story_doc = {"meta": {"source": "cn", "version": "2", "last_updated": 3}, "episodes": {"2": {"scenarioId": "x", "title": "t", "talkData": {"z": "1", "a&": "2"}, "talkOrder": ["a&", "nope"]}}}
    (tmp_path / "in/event_5.json").write_text(json.dumps(story_doc))
    (tmp_path / "in/event_6.json").write_text("broken")
    files = readers.documents(spark, f"{tmp_path}/in")
    rows = readers.load_categories(files.where("name like '%.full.json'"), files.where("name not like '%.full.json'"))
    got = {(r.category, r.jp_key): (r.cn_text, r.source, r.ids) for r in rows.collect()}
    assert got == {("virtualLive", "q"): ("Q", "cn", ["1", "2"]), ("virtualLive", "r"): ("R & <b>", "human", ["1"]), ("virtualLive", "s"): ("", "unknown", []), ("events", "e"): ("E", "unknown", [])}
    assert {r.category: r.recovered for r in readers.recovery_report(rows).collect()} == {"virtualLive": 2, "events": 0}
    broken = spark.createDataFrame([("cards.full.json", '{"f": {"k": 5}}')], "name string, value string")
    with pytest.raises(Exception, match="unparseable"):
        readers.full_rows(broken, readers.flat_rows(files.limit(0))).collect()
    stories = readers.stories(files)
    assert [r.event_id for r in stories.collect()] == [5]
    _, _, lines = story.store_story(stories, 1)
    assert [r.jp_key for r in lines.orderBy("position").collect()] == ["a&", "z"]

    stored = rows.select("category", "field", "jp_key", "cn_text", "source", "ids", F.lit(1).cast("bigint").alias("updated_at"), F.lit("u").alias("updated_by"))
    out = {r.path: r.body for r in export.category_files(stored).collect()}
    assert len(out) == 2 * len(model.CATEGORIES)
    assert out["translation/virtualLive.json"] == '{\n  "name": {\n    "q": "Q",\n    "r": "R \\u0026 \\u003cb\\u003e",\n    "s": ""\n  }\n}'
    assert json.loads(out["translation/virtualLive.full.json"])["name"]["r"] == {"text": "R & <b>", "source": "human", "ids": ["1"]}
    assert "a&" in export.story_files(story.ordered_detail(*story.store_story(stories, 1))).first().body
    assert verify.difference(stored, stored).isEmpty()
    assert export.assets(export.category_files(stored)).first().etag.startswith('"')


def test_search_index(spark):
    cards = docs(spark, {"id": "1", "prefix": "n", "characterId": 0}, {"id": 2, "prefix": " "}, {"id": 3, "prefix": "p", "characterId": 4})
    costumes = docs(spark, {"id": 1, "name": "-"}, {"id": 2, "name": "c"})
    stored = spark.createDataFrame([("cards", "prefix", "n", "n", "cn", [], 1, "u"), ("cards", "prefix", "p", "P", "cn", [], 1, "u")], model.ENTRIES)
    rows = search_index.index_rows({"cards": cards, "costumes": costumes}, stored)
    got = [r.j for r in rows.orderBy("part", "ord").select(search_index.index_json().alias("j")).collect()]
    assert got == ['{"id":1,"n":"n","g":"cards"}', '{"id":3,"n":"p","g":"cards","c":4,"cn":"P"}', '{"id":2,"n":"c","g":"costumes"}']
    assert search_index.index_rows({}, stored) is None


def test_sync_job(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/entries", model.ENTRIES, "category")
    source = {"events": docs(spark, {"id": 1, "name": "a"}), "mysekaiFixtureTags": docs(spark, {"id": 1, "name": "t"}), "mysekaiFixtures": docs(spark, {"id": 2, "name": "x", "flavorText": "t"}), "mysekaiFixtureMainGenres": docs(spark)}
    target = {"events": docs(spark, {"id": 1, "name": "A"}), "mysekaiFixtureTags": docs(spark, {"id": 1, "name": "T"}), "mysekaiFixtures": docs(spark), "mysekaiFixtureMainGenres": docs(spark)}
    done = sync.sync(table, source, target, now=4)
    assert done["changed"] == {"events": 1, "mysekai": 4} and "cards" in done["skipped"]
    assert {(r.field, r.jp_key): r.cn_text for r in readers.stored(table, "mysekai").collect()} == {("tag", "t"): "T", ("fixtureName", "x"): "", ("flavorText", "t"): "T"}
    again = sync.sync(table, source, target, now=5)
    assert "events" not in again["changed"]


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 03:00:00")], "k int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = refresh.debounced_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "k", "ts", "2 seconds", "1 minute")
    seen = []
    refresh.on_change(stream, lambda rows, batch: seen.extend(tuple(r) for r in rows.select("k", "changes").collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted(seen) == [(1, 1), (1, 2)]


def test_fetch(tmp_path):
    def get(url):
        if url == "bad":
            raise OSError("http 404")
        return url

    assert fetch.first_good(get, ["bad", "ok"], delay=0.05) == "ok"
    with pytest.raises(RuntimeError, match="404"):
        fetch.first_good(get, ["bad"], delay=0.05, again=0)
    assert fetch.first_complete(get, ["bad", "part", "whole"], lambda a: a == "whole") == "whole"
    assert fetch.first_complete(get, ["bad", "part"], lambda a: a == "whole") == "part"
    assert fetch.distinct([" a", "a ", "", "b"]) == ["a", "b"] and fetch.expand("{repo}/x/{branch} ", "r", "b") == "r/x/b"
    assert fetch.retry_after("12", 0) == 12 and fetch.retry_after("x", 0) == 0 and fetch.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 10) == 50
    (tmp_path / "a").mkdir()
    (tmp_path / "a/f").write_text("x")
    fetch.unpack(fetch.pack(str(tmp_path / "a")), str(tmp_path / "b"))
    assert (tmp_path / "b/f").read_text() == "x"


def test_gap_jobs(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/e", model.ENTRIES, "category")
    table.write(entries(spark, ("a", "", "unknown", []), ("b", "", "llm", []), ("c", "x", "human", [])))
    assert gaps.fill_entries(table, lambda t: [x.upper() for x in t], 5) == {"translated": 2, "skipped": 0, "errors": ""}
    assert {r.jp_key: (r.cn_text, r.source) for r in table.read().collect()} == {"a": ("A", "llm"), "b": ("B", "llm"), "c": ("x", "human")}
    table.write(entries(spark, ("a", "", "unknown", [])))
    assert gaps.fill_entries(table, lambda t: [""], 5, tries=1, wait=0)["errors"] == "0 of 1 texts came back"

    heads, eps, lines = (SnapshotTable(spark, f"{tmp_path}/{n}", schema) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES)))
    heads.write(spark.createDataFrame([(99, "jp_pending", "1.0", 1)], model.STORIES))
    eps.write(spark.createDataFrame([(99, "1", "s", "", "", 0)], model.EPISODES))
    lines.write(spark.createDataFrame([(99, "1", f"k{i}", "", "unknown", "", i) for i in range(4)], model.LINES))

    def down(texts):
        if "k2" in texts:
            raise OSError("down")
        return [t.upper() for t in texts]

    with pytest.raises(RuntimeError, match="OSError: down"):
        gaps.fill_story(heads, eps, lines, 99, down, 2, size=2, wait=0)
    assert lines.read().where("cn_text = ''").count() == 2
    assert gaps.fill_story(heads, eps, lines, 99, lambda texts: [t.upper() for t in texts], 3, size=2) == 2
    assert heads.read().first().source == "llm" and lines.read().where("cn_text = ''").count() == 0


def test_files_on_disk(spark, tmp_path):
    files = spark.createDataFrame([("a/b.json", "{}"), ("c.json", "é")], "path string, body string")
    assert export.write_files(files, str(tmp_path)) == 2
    assert (tmp_path / "c.json").read_text() == "é" and sorted(p.name for p in tmp_path.rglob("*.json")) == ["b.json", "c.json"]


def test_a_mirror_that_hangs_holds_up_nothing():
    import time

    def get(url):
        if url == "slow":
            time.sleep(4)
        return url

    began = time.monotonic()
    assert fetch.first_good(get, ["slow", "ok"], delay=0.02) == "ok"
    assert time.monotonic() - began < 1


def test_incomplete_answers_and_passing_failures():
    asked = []

    def get(url):
        asked.append(url)
        if url == "down" and asked.count("down") == 1:
            raise OSError("http 503")
        return {"down": "whole", "a": "part a", "b": "part b"}[url]

    assert fetch.first_complete(get, ["down", "a"], lambda x: x == "whole", again=0) == "whole"
    assert asked == ["down", "a", "down"]
    assert fetch.first_complete(get, ["a", "b"], lambda x: x == "whole", again=0) == "part b"


def test_version_poll():
    seen = []

    def get(url, etag, modified):
        seen.append((url, etag))
        if url == "busy":
            raise fetch.TooMany("120")
        return (None, "e1", "m") if etag == "e1" else ({"dataVersion": "v1"}, "e1", "m")

    poll = fetch.VersionPoll(get, ["u", "u"], interval=10)
    assert poll.fetch(0) == poll.fetch(1) == {"dataVersion": "v1"} and seen == [("u", ""), ("u", "e1")]
    busy = fetch.VersionPoll(get, ["busy"], interval=10)
    with pytest.raises(RuntimeError, match="429"):
        busy.fetch(100)
    assert busy.until == 220
    with pytest.raises(RuntimeError, match="pauses"):
        busy.fetch(219)
    assert fetch.pause("", 0, 10) == 3600 and fetch.pause("", 0, 9000) == 18000 and fetch.pause("x", 0, 1e9) == 21600 and fetch.pause("9999999", 0, 1) == 86400


def test_mirrors_whose_answer_is_no_version():
    asked = []

    def get(url, etag, modified):
        asked.append(url)
        if url == "shaky" and asked.count("shaky") == 1:
            raise OSError("http 503")
        return {"unknown": (None, "", ""), "bare": ({"appVersion": "1"}, "", ""), "shaky": ({"dataVersion": "2"}, "", "")}[url]

    # Only the mirror whose failure may pass is asked again.
    assert fetch.VersionPoll(get, ["unknown", "bare", "shaky"]).fetch(0) == {"dataVersion": "2"}
    assert sorted(asked) == ["bare", "shaky", "shaky", "unknown"]
    with pytest.raises(RuntimeError, match="no version is known"):
        fetch.VersionPoll(get, ["unknown"]).fetch(0)
    with pytest.raises(RuntimeError, match="no dataVersion"):
        fetch.VersionPoll(get, ["bare"]).fetch(0)


def test_breaker_and_digests(spark):
    breaker = fill.Breaker(60)
    assert breaker.closed(0) is None
    breaker.failed("down", 10)
    assert "down" in breaker.closed(69) and breaker.closed(70) is None
    assert fill.automatic(45) == {"timeout": 30.0, "tries": 1} and fill.automatic(5)["timeout"] == 5
    from glossweave.functions import arrays

    row = spark.range(1).select(
        arrays.error_digest(F.array(*map(F.lit, "abcde"))).alias("five"), arrays.error_digest(F.array().cast("array<string>")).alias("none"),
        arrays.skipped_digest(F.array(F.lit("cards"), F.lit("music")), F.array(F.lit("x" * 300), F.lit(" "))).alias("skipped"),
    ).first()
    assert row.five == "5 failed: a; b; c; 2 more" and row.none is None
    assert row.skipped == "data sync skipped: cards: " + "x" * 280 + "…; music"


def test_strict_precedence_spares_what_the_default_spares(spark):
    stored = entries(spark, ("p", "", "pinned", []), ("h", "x", "human", []), ("c", "old", "cn", []))
    pairs = spark.createDataFrame([("cards", "prefix", k, "new") for k in "phc"], "category string, field string, jp_key string, cn_text string").withColumns({"category": F.lit(stored.first().category), "field": F.lit(stored.first().field)})
    traces = pairs.select("category", "field", "jp_key", F.array().cast("array<string>").alias("ids")).limit(0)
    got = {r.jp_key: (r.cn_text, r.source) for r in merge.sync_merge(stored, pairs, traces, 1, strict_precedence=True).collect()}
    assert got == {"p": ("", "pinned"), "h": ("x", "human"), "c": ("new", "cn")}


def test_streak_over_many_ranges(spark, monkeypatch):
    import random

    monkeypatch.setattr(story, "WALK_RANGE", 4)
    rng = random.Random(3)
    for limit in (3, 6, 100):
        outcome = {i: rng.choice(["keep", "found", "miss", "miss", "miss", "error"]) for i in rng.sample(range(1, 90), 60)}
        want, streak = [], 0
        for i in sorted(outcome):
            if i < 5:
                continue
            streak = 0 if outcome[i] in ("keep", "found") else streak + (outcome[i] == "miss")
            want.append((i, streak))
            if outcome[i] == "miss" and streak >= limit:
                break
        walked = story.walk_streak(spark.createDataFrame(list(outcome.items()), "event_id bigint, outcome string"), 5, limit)
        assert sorted((r.event_id, r.streak) for r in walked.collect()) == want


def test_missing_documents_skip_a_category(spark):
    one = docs(spark, {"id": 1, "name": "x"})
    with pytest.raises(LookupError, match="target events"):
        extract.extract("events", {"events": one}, {})
    pairs, traces, skipped = sync.gather({"events": one, "skills": docs(spark, {"id": 1, "description": "d"})}, {"skills": docs(spark)}, ["events", "skills"])
    assert list(skipped) == ["events"] and [r.field for r in pairs.collect()] == ["description"]


def test_import_report(spark):
    files = spark.createDataFrame([("event_1.json", '{"meta": {"source": "llm"}, "episodes": {}}'), ("event_2.json", "{"), ("other.json", '{"episodes": {}}')], "name string, value string")
    assert {r.name for r in readers.import_report(files).collect()} == {"event_2.json", "other.json"}
    assert [r.event_id for r in readers.stories(files).collect()] == [1]


def test_an_old_index_stays_if_no_document_came(spark):
    from glossweave.operators import search_index

    old = spark.createDataFrame([(1,)], "id bigint")
    assert search_index.next_index({}, entries(spark), old) is old


def _story_list(spark, *events):
    return docs(spark, *({"eventId": i, "assetbundleName": f"a{i}", "eventStoryEpisodes": [{"episodeNo": 1, "scenarioId": f"s{i}", "title": f"{mark}{i}"}]} for i, mark in events))


def _scenarios(spark, rows):
    import json

    return spark.createDataFrame([(i, "1", None if t is None else json.dumps({"TalkData": [{"Body": b, "WindowDisplayName": n} for b, n in t]})) for i, t in rows], "event_id bigint, episode_no string, text string").select("event_id", "episode_no", F.try_parse_json("text").alias("doc"))


def test_story_jobs(spark, tmp_path):
    from glossweave.plans import stories

    tables = stories.Tables(*(SnapshotTable(spark, f"{tmp_path}/{n}", schema) for n, schema in (("s", model.STORIES), ("p", model.EPISODES), ("l", model.LINES))))
    tables.stories.write(spark.createDataFrame([(1, "official_cn", "1.0", 1), (3, "human", "1.0", 1)], model.STORIES))
    landed = stories.Landed(
        _story_list(spark, *((i, "t") for i in range(1, 11))), _story_list(spark, *((i, "T") for i in (1, 2, 3, 4, 5))), spark.createDataFrame([(i,) for i in range(1, 6)], "event_id bigint"),
        _scenarios(spark, [(i, [(f"hello {i}", "A"), (f"bye {i}", "B")]) for i in range(1, 10)]), _scenarios(spark, [(i, None if i == 4 else [(f"HELLO {i}", "AA"), (f"BYE {i}", "BB")]) for i in range(1, 6)]),
    )
    got = stories.sync_stories(tables, landed, 7)
    # 2 and 5 are official, 3 is a person's, 4 lacks a scenario, 6 to 8 aren't there: what is newer than any stored comes as pending.
    assert (got["official"], got["pending"]) == (2, 5) and got["errors"].startswith("2 failed: event 10: no source") and "event 4: no target" in got["errors"]
    assert {r.event_id: r.source for r in tables.stories.read().collect()} == {1: "official_cn", 2: "official_cn", 3: "human", 5: "official_cn"} | {i: "jp_pending" for i in range(6, 11)}
    assert [(r.jp_key, r.cn_text) for r in tables.lines.read().where("event_id = 2").orderBy("position").collect()] == [("hello 2", "HELLO 2"), ("A", "AA"), ("bye 2", "BYE 2"), ("B", "BB")]
    assert stories.sync_stories(tables, landed, 8)["official"] == 0

    totals = gaps.fill_stories(tables.stories, tables.episodes, tables.lines, lambda texts: [t.upper() for t in texts], 9)
    assert totals["stories"] == 5 and totals["skipped"] == 0 and totals["translated"] == totals["candidates"] > 0
    assert {r.source for r in tables.stories.read().where("event_id > 5").collect()} == {"llm"}

    assert stories.retry_stories(tables, landed, [3, 4], 10) == {3: {"source": "official_cn", "episodes": 1}, 4: {"source": "jp_pending", "episodes": 1}}
    with pytest.raises(LookupError, match="99"):
        stories.retry_stories(tables, landed, [99], 10)

    turned = _scenarios(spark, [(2, [("bye 2", "B"), ("new", "A")])])
    assert stories.reorder_stories(tables, turned, [2]) == 1
    assert [r.jp_key for r in tables.lines.read().where("event_id = 2").orderBy("position").collect()] == ["bye 2", "B", "A", "hello 2"]
