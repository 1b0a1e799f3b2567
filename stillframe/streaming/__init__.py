"""Structured Streaming into a table: files arrive in a folder, their names carry the snapshot time."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Table
from ..errors import CommitConflict, IngestRejected

PATTERN = r"(?<!\d)(\d{10,16})(?!\d)[^/]*$"
log = logging.getLogger("stillframe")


def watch_csv(table: Table, folder: str, checkpoint: str, pattern: str = PATTERN) -> StreamingQuery:
    """Import every CSV file of a folder, each as the snapshot of the milliseconds in its name; late files are
    backfill. A batch that is tried again is harmless: committed snapshots answer from the log.

    One bad file stops no other: a name without a time, a malformed file, or other content at a time that has a
    snapshot (two files of one time) is logged and listed, with the reason, in `_rejected/` of the table.
    """
    names = table.spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(folder).select("path")

    def batch(df, number: int) -> None:
        time = F.regexp_extract("path", pattern, 1).try_cast("long")
        found = [(r["path"], r["ts"]) for r in df.select("path", time.alias("ts")).orderBy("ts", "path").collect()]  # a row per file
        rejected = {p: "no time in the name" for p, ts in found if ts is None}
        files = [(p, ts) for p, ts in found if ts is not None]
        try:
            if len({ts for _, ts in files}) < len(files):
                raise IngestRejected("two files of one time")
            if files:
                table.ingest_csvs([p for p, _ in files], [ts for _, ts in files])
        except IngestRejected:
            for p, ts in files:
                try:
                    table.ingest_csv(p, ts)
                except IngestRejected as e:
                    rejected[p] = str(e)
        if rejected:
            log.warning("not imported: %s", rejected)
            try:
                table.store.put_json(f"{table.root}/_rejected/{query_id()}-{number}.json", rejected)
            except CommitConflict:
                pass  # an earlier try of this batch reported it

    def query_id() -> str:
        return str(query.id)

    query = names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query
