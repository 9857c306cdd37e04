"""Change events of documents (I02): from versions of a document, one row per thing that changed.

A version is (doc_id, version, pages, metadata, saved): digests of what is on the pages and of the
metadata, and whether the version is the one on disk. Events are (doc_id, version, event, dirty):
``pages-changed`` and ``metadata-changed`` where a digest differs from the version before, and
``dirty-changed`` where the document went from saved to unsaved or back (dirty says which). The first
version of a document, taken as saved before it, is what others are compared with. A null digest is a
value of its own; versions without doc_id or number are left out, and of rows of one number the first
in order of their values counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VALUES = ["pages", "metadata", "saved"]
EVENTS = "doc_id long, version long, event string, dirty boolean"
_STATE = "version long, pages string, metadata string, saved boolean"


def change_events(versions: DataFrame) -> DataFrame:
    """I02 of a table of all versions."""
    known = versions.where("doc_id IS NOT NULL AND version IS NOT NULL")
    saved = F.coalesce("saved", F.lit(False)).alias("saved")
    rows = known.groupBy("doc_id", "version").agg(F.min(F.struct("pages", "metadata", saved)).alias("v")).select("doc_id", "version", "v.*")
    order = Window.partitionBy("doc_id").orderBy("version")
    first = F.row_number().over(order) == 1
    was = {c: F.lag(c).over(order) for c in VALUES}
    changed = {c: ~first & ~F.col(c).eqNullSafe(was[c]) for c in ("pages", "metadata")}
    turned = F.col("saved") != F.coalesce(was["saved"], F.lit(True))
    event = F.array(F.when(changed["pages"], "pages-changed"), F.when(changed["metadata"], "metadata-changed"), F.when(turned, "dirty-changed"))
    told = rows.withColumn("event", F.array_compact(event))
    return told.select("doc_id", "version", F.explode("event").alias("event"), (~F.col("saved")).alias("dirty"))


def _follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get if state.exists else None
    rows = sorted({(int(v), p or "", p is not None, m or "", m is not None, bool(s)) for part in parts for v, p, m, s in part[["version", *VALUES]].astype(object).where(part[["version", *VALUES]].notna(), None).itertuples(index=False)}, key=lambda r: (r[0], r[2], r[1], r[4], r[3], r[5]))
    out = []
    for version, p, has_p, m, has_m, saved in rows:
        if before and version <= before[0]:
            continue
        now = (version, p if has_p else None, m if has_m else None, saved)
        if before:
            out += [(key[0], version, f"{name}-changed", not saved) for name, i in (("pages", 1), ("metadata", 2)) if now[i] != before[i]]
        if saved != (before[3] if before else True):
            out.append((key[0], version, "dirty-changed", not saved))
        before = now
    if before:
        state.update(before)
    yield pd.DataFrame(out, columns=["doc_id", "version", "event", "dirty"])


def change_feed(versions: DataFrame) -> DataFrame:
    """I02 of a stream of versions, which keeps the last version of each document as state. A version
    that isn't newer than it (a replay, or one that comes late) has no events. A document's new
    versions of a batch are one group: edits of one document between two triggers."""
    known = versions.where("doc_id IS NOT NULL AND version IS NOT NULL").select("doc_id", "version", "pages", "metadata", F.coalesce("saved", F.lit(False)).alias("saved"))
    return known.groupBy("doc_id").applyInPandasWithState(_follow, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)
