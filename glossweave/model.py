"""Tables of the curation engine: columns, keys and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTRIES = "category string, field string, jp_key string, cn_text string, source string, ids array<string>, updated_at bigint, updated_by string"
STORIES = "event_id bigint, source string, version string, last_updated bigint"
EPISODES = "event_id bigint, episode_no string, scenario_id string, title string, title_source string, position int"
LINES = "event_id bigint, episode_no string, jp_key string, cn_text string, source string, speaker_name string, position int"
SETTINGS = "key string, value string, encrypted boolean"

ENTRY_KEY = ["category", "field", "jp_key"]
LINE_KEY = ["event_id", "episode_no", "jp_key"]

#: Categories in their order of display, and entry sources by rank.
CATEGORIES = ["cards", "skills", "events", "information", "music", "gacha", "virtualLive", "sticker", "comic", "mysekai", "costumes", "characters", "units"]
CN, HUMAN, PINNED, LLM, UNKNOWN = "cn", "human", "pinned", "llm", "unknown"
RANK = {PINNED: 4, HUMAN: 3, CN: 2, LLM: 1, UNKNOWN: 0}
#: Title sources whose title still waits for a translation.
PENDING = ["", UNKNOWN, "jp_pending"]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
