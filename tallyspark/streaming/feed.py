"""The bot's updates as a streaming source, and one-time tokens as state of their users.

``bot_updates`` is a Spark data source with the feed's own contract: updates from an offset on, ``limit`` at most. The offset is
the last update's id and one, and lies in the query's checkpoint, so a query that starts again goes on where it had
stopped. A batch makes up to ``requests`` such requests, one unless the option says more. The option ``feed`` names a folder of Parquet
files (update_id, chat_id, text, at) that stands for the feed. The driver finds where requests end by the ids of row groups that may
hold the next ones, and keeps no more ids than a batch has; executors read the updates. In a feed written in order
of its ids a batch costs what it holds; in one without order each batch looks at all ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT = 20
#: Tasks that share a batch's requests, about.
TASKS = 24
UPDATES = "update_id long, chat_id string, text string, at timestamp"
#: What happens to tokens: kind is "token" (one is made for the user) or "start" (a chat sends it).
TOKEN_EVENTS = "user_id long, kind string, token string, chat_id string, update_id long, at timestamp, expires_at timestamp"
#: Groups that users are dealt into, and the one of those without an id (whose column would turn ids beside it into floats).
BUCKETS, NOBODY = 4096, -1
OUTCOMES = "update_id long, user_id long, token string, chat_id string, outcome string"


class Requests(InputPartition):
    """Updates from ``first`` to before ``behind``, and the row groups (by file) that may hold some."""

    def __init__(self, first: int, behind: int, groups: dict[str, list[int]]):
        self.first, self.behind, self.groups = first, behind, groups


class FeedReader(DataSourceStreamReader):
    def __init__(self, feed: str, limit: int, requests: int):
        self.feed, self.limit, self.requests = feed, limit, requests
        self.next: int | None = None
        self.known: dict[tuple, list[tuple]] = {}  # by file, size and time: (least id, greatest id, number) of its row groups

    def initialOffset(self) -> dict:
        return {"next": 0}

    def _groups(self, first: int, behind: int | None = None) -> list[tuple]:
        """(least id, greatest id, file, number) of the row groups that may hold these updates, by least id."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        from tallyspark.sources.objects import opened

        store, path = opened(self.feed)
        found = []
        for f in store.get_file_info(fs.FileSelector(path, recursive=True)):
            if not f.is_file or f.base_name.startswith(("_", ".")):
                continue
            key = (f.path, f.size, f.mtime_ns)
            if key not in self.known:
                meta = pq.read_metadata(f.path, filesystem=store)
                self.known[key] = [(*bounds(meta.row_group(i)), i) for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
            found += [(low, high, f.path, i) for low, high, i in self.known[key] if high >= first and (behind is None or low < behind)]
        return sorted(found)

    def _ids(self, first: int, behind: int | None, most: int) -> np.ndarray:
        """The first ``most`` ids from ``first`` on, in order."""
        import pyarrow.parquet as pq

        from tallyspark.sources.objects import opened

        store, _ = opened(self.feed)
        ids = np.zeros(0, np.int64)
        for low, _, file, i in self._groups(first, behind):
            if len(ids) == most and low > ids[-1]:
                break
            with pq.ParquetFile(file, filesystem=store) as f:
                more = f.read_row_group(i, columns=["update_id"]).column(0).drop_null().to_numpy()
            more = more[(more >= first) & (more < behind if behind is not None else True)]
            ids = np.sort(np.concatenate([ids, more]))[:most]
        return ids

    def latestOffset(self) -> dict:
        self.next = self.initialOffset()["next"] if self.next is None else self.next
        ids = self._ids(self.next, None, self.limit * self.requests)
        return {"next": int(ids[-1]) + 1 if len(ids) else self.next}

    def partitions(self, start: dict, end: dict) -> list[Requests]:
        first, behind = start["next"], end["next"]
        self.next = behind  # Spark asks for a batch, if only an empty one, before it asks how far a query that starts again may go
        if first >= behind:
            return []
        ids, groups = self._ids(first, behind, self.limit * self.requests), self._groups(first, behind)
        edges = [first, *(int(x) for x in ids[:: self.limit * max(1, self.requests // TASKS)][1:]), behind]
        made = []
        for a, b in zip(edges, edges[1:], strict=False):
            mine: dict[str, list[int]] = {}
            for low, high, file, i in groups:
                if high >= a and low < b:
                    mine.setdefault(file, []).append(i)
            made.append(Requests(a, b, mine))
        return made

    def read(self, partition: Requests) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        from tallyspark.sources.objects import opened

        store, _ = opened(self.feed)
        names = [c.split()[0] for c in UPDATES.split(", ")]
        parts = []
        for file, groups in partition.groups.items():
            with pq.ParquetFile(file, filesystem=store) as f:
                for i in groups:
                    rows = f.read_row_group(i, columns=names).select(names)
                    parts.append(rows.filter((pc.field("update_id") >= partition.first) & (pc.field("update_id") < partition.behind)))
        for found in [pa.concat_tables(parts).sort_by("update_id")] if parts else []:
            # Files may hold times without a zone, in UTC.
            at = found.column("at").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
            yield from found.set_column(names.index("at"), "at", at).to_batches(max_chunksize=10_000)


def bounds(group) -> tuple[int, int]:
    """The least and greatest id of a row group; all that there are if its file does not say."""
    for k in range(group.num_columns):
        held = group.column(k)
        if held.path_in_schema == "update_id" and held.statistics is not None and held.statistics.has_min_max:
            return held.statistics.min, held.statistics.max
    return -(1 << 63), (1 << 63) - 1


class BotUpdates(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bot_updates"

    def schema(self) -> str:
        return UPDATES

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options["feed"], int(self.options.get("limit", LIMIT)), int(self.options.get("requests", 1)))


def updates(spark: SparkSession, feed: str, limit: int = LIMIT, requests: int = 1) -> DataFrame:
    """The feed as a stream of updates; one batch makes at most ``requests`` requests of ``limit``."""
    spark.dataSource.register(BotUpdates)
    return spark.readStream.format("bot_updates").option("feed", feed).option("limit", limit).option("requests", requests).load()


def step(key: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Outcomes of one bucket's starts; the state is, for each user there, the newest token, when it expires, and whether it was used."""
    held = {u: known for u, *known in zip(*state.get, strict=True)} if state.exists else {}
    e = pd.concat(events).sort_values(["at", "update_id"], kind="stable")
    nanoseconds = lambda c: e[c].to_numpy("datetime64[ns]").astype(np.int64).tolist()
    users = [None] * len(e) if key[0] == NOBODY else e["user_id"].tolist()
    rows = []
    for user, kind, token, chat, number, at, until in zip(users, e["kind"], e["token"], e["chat_id"], e["update_id"], nanoseconds("at"), nanoseconds("expires_at"), strict=True):
        if kind == "token":
            held[user] = [token, until, False]
            continue
        newest, expires, used = mine = held.setdefault(user, [None, None, False])
        outcome = "UNKNOWN" if token != newest else "USED" if used else "EXPIRED" if at > expires else "LINKED"
        mine[2] = used or outcome == "LINKED"
        rows.append((number, user, token, chat, outcome))
    state.update(([*held], *map(list, zip(*held.values(), strict=True))))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOMES.split(", ")])


def token_outcomes(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What becomes of each start, for a stream of ``TOKEN_EVENTS`` whose batches are in order of time.

    A new token of a user voids the older ones, which are UNKNOWN from then on. A valid one is LINKED by its first start in order of
    (at, update_id) and USED after that; one past its time is EXPIRED. Only the newest token of a user is kept. The state of users is
    kept by bucket, as a hash deals them, since Spark takes milliseconds for each group that it hands to Python; a batch writes the buckets
    that it has events of. A checkpoint holds for one number of buckets.
    """
    bucket = F.when(F.col("user_id").isNull(), F.lit(NOBODY)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    state = "user_id array<long>, token array<string>, expires array<long>, used array<boolean>"
    return events.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(step, OUTCOMES, state, "append", GroupStateTimeout.NoTimeout)


def token_events(starts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``TOKEN_EVENTS`` of messages (update_id, chat_id, token, at) and made tokens (user_id, token, created_at, expires_at); starts of tokens that nobody has are left out."""
    nothing = lambda kind: F.lit(None).cast(kind)
    made = tokens.select("user_id", F.lit("token").alias("kind"), "token", nothing("string").alias("chat_id"), F.lit(-1).cast("long").alias("update_id"), F.col("created_at").alias("at"), "expires_at")
    tried = starts.join(tokens.select("token", "user_id"), "token").select("user_id", F.lit("start").alias("kind"), "token", "chat_id", "update_id", "at", nothing("timestamp").alias("expires_at"))
    return made.unionByName(tried)
