"""Streams of attempts and snapshots. The batch operators define the right result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagedrift.operators.events import FALLBACK_DATE, SPAN_HOURS, STREAK

#: Midnight in Dhaka is 18:00 UTC.
DHAKA_DAY = ("1 day", "1 day", "18 hours")


def daily_volume(attempts: DataFrame, late: str = "2 days") -> DataFrame:
    """Attempts by outcome and local day, from a stream with started_at and outcome; a day closes once it is `late` past."""
    days = attempts.withWatermark("started_at", late).groupBy(F.window("started_at", *DHAKA_DAY).alias("w"), "outcome").agg(F.count("*").alias("n"))
    return days.select(F.to_date(F.from_utc_timestamp(F.col("w.start"), "Asia/Dhaka")).alias("day"), "outcome", "n")


SNAPSHOT = ["id", "fetched_at", "headline_hash", "byline", "byline_hash", "body_hash", "published_at", "date_source", "final_url"]
CHANGE = "article_id long, detected_at timestamp, from_snapshot_id long, to_snapshot_id long, type string, confidence string"
CHANGE_STATE = "last string, waiting string"


def _blank(x: str | None) -> bool:
    return not (x or "").strip(" ")


def _between(was: dict, now: dict) -> Iterator[tuple[str, str]]:
    """Types and confidences of what changed between two snapshots."""
    if was["headline_hash"] != now["headline_hash"]:
        yield "HEADLINE_CHANGED", "confirmed"
    if was["byline_hash"] != now["byline_hash"]:
        yield ("BYLINE_REMOVED" if _blank(now["byline"]) and not _blank(was["byline"]) else "BYLINE_CHANGED"), "confirmed"
    if was["body_hash"] != now["body_hash"]:
        yield "BODY_CHANGED", "confirmed"
    if (was["published_at"] or "") != (now["published_at"] or ""):
        yield "DATE_CHANGED", "unverified" if FALLBACK_DATE in (was["date_source"], now["date_source"]) else "confirmed"
    if was["final_url"] != now["final_url"]:
        yield "REDIRECTED", "confirmed"


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    rows = pd.concat(list(batches))[columns]
    return rows.astype(object).where(rows.notna(), None)


def _loaded(text: str | None) -> list[dict]:
    if not text:
        return []
    rows = pd.read_json(text, orient="records", dtype=False, convert_dates=False).astype(object)
    return rows.where(rows.notna(), None).to_dict("records")


def _dumped(rows: list[dict]) -> str:
    return pd.DataFrame(rows, dtype=object).to_json(orient="records") if rows else ""


def _micros(x) -> int:
    return pd.Timestamp(x).value // 1000


def _settled(waiting: list[dict], watermark_ms: int) -> tuple[list[dict], list[dict]]:
    """Rows that no late row can come before any more, in order, and the others."""
    waiting.sort(key=lambda r: (r["at"], r["id"]))
    n = sum(r["at"] < watermark_ms * 1000 for r in waiting)
    return waiting[:n], waiting[n:]


def _changes(keep: str):
    span = pd.Timedelta(keep).value // 1000

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = ([], []) if not state.exists else map(_loaded, state.get)
        if not state.hasTimedOut:
            for r in _rows(batches, SNAPSHOT).to_dict("records"):
                waiting.append({**r, "id": int(r["id"]), "at": _micros(r.pop("fetched_at"))})
        for r in waiting:
            r.pop("fetched_at", None)
        ready, waiting = _settled(waiting, state.getCurrentWatermarkMs())
        out = []
        for now in ready:
            for was in last if not last or now["at"] - last[0]["at"] <= span else []:
                out += [(key[0], pd.Timestamp(now["at"] * 1000), was["id"], now["id"], *what) for what in _between(was, now)]
            last = [now]
        if state.hasTimedOut and not ready and not waiting:
            state.remove()
        else:
            state.update((_dumped(last), _dumped(waiting)))
            head = waiting[0]["at"] // 1000 + 1 if waiting else last[-1]["at"] // 1000 + pd.Timedelta(keep).value // 1_000_000
            state.setTimeoutTimestamp(max(head, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["article_id", "detected_at", "from_snapshot_id", "to_snapshot_id", "type", "confidence"])

    return changes


def changes(snapshots: DataFrame, late: str = "2 hours", keep: str = "400 days") -> DataFrame:
    """All changes between consecutive snapshots, as events.snapshot_changes() gives them: CHANGE.

    snapshots: article_id and SNAPSHOT. Rows up to `late` behind the newest are put in order first, so an article's events come
    once its rows are that old. The state of an article is its last snapshot without its body, and the rows that wait; it goes
    after `keep` without a snapshot, which is longer than the last step of the recheck schedule. A later snapshot is then the
    first again.
    """
    rows = snapshots.withWatermark("fetched_at", late)
    return rows.groupBy("article_id").applyInPandasWithState(_changes(keep), CHANGE, CHANGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


ABSENCE = "article_id long, detected_at timestamp, fetch_attempt_id long, to_snapshot_id long, type string, confidence string"
ABSENCE_STATE = "streak string, waiting string, seen boolean, absent boolean, at long"
KINDS = {("http_error", 404): "GONE_404", ("http_error", 410): "GONE_410"}


def _absences(keep: str):
    span = pd.Timedelta(keep).value // 1000

    def absences(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, waiting, seen, absent, before = ("", "", False, False, 0) if not state.exists else state.get
        streak, waiting = _loaded(streak), _loaded(waiting)
        if not state.hasTimedOut:
            for r in _rows(batches, ["id", "started_at", "outcome", "http_status"]).to_dict("records"):
                waiting.append({"id": int(r["id"]), "at": _micros(r["started_at"]), "outcome": r["outcome"], "status": None if r["http_status"] is None else int(r["http_status"])})
        ready, waiting = _settled(waiting, state.getCurrentWatermarkMs())
        out = []
        for r in ready:
            at = pd.Timestamp(r["at"] * 1000)
            if r["at"] - before > span:
                streak, seen, absent = [], False, False
            before = r["at"]
            if r["outcome"] == "ok":
                if seen and absent:
                    out.append((key[0], at, None, r["id"], "RESTORED", "confirmed"))
                seen, streak = True, []
                continue
            kind = "ROBOTS_BLOCKED" if r["outcome"] == "robots_blocked" else KINDS.get((r["outcome"], r["status"]))
            streak = [*streak, {"at": r["at"], "kind": kind}][-STREAK:]
            if kind and len(streak) == STREAK and {s["kind"] for s in streak} == {kind} and r["at"] - streak[0]["at"] >= SPAN_HOURS * 3_600_000_000:
                out.append((key[0], at, r["id"], None, kind, "probable" if kind == "ROBOTS_BLOCKED" else "confirmed"))
                absent = True
        if state.hasTimedOut and not ready and not waiting:
            state.remove()
        else:
            state.update((_dumped(streak), _dumped(waiting), seen, absent, before))
            head = waiting[0]["at"] // 1000 + 1 if waiting else ready[-1]["at"] // 1000 + pd.Timedelta(keep).value // 1_000_000
            state.setTimeoutTimestamp(max(head, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["article_id", "detected_at", "fetch_attempt_id", "to_snapshot_id", "type", "confidence"])
        yield frame.astype({"fetch_attempt_id": "Int64", "to_snapshot_id": "Int64"})

    return absences


def absences(attempts: DataFrame, late: str = "2 hours", keep: str = "400 days") -> DataFrame:
    """Events of documents that are gone or back, as events.gone_events() and events.restored_events() give them: ABSENCE.

    attempts: article_id, id, started_at, outcome, http_status; an ok attempt is a snapshot. Rows are put in order as in
    changes(); the state of an article is its last failures in a row, the rows that wait, and whether it was seen and absent.
    """
    rows = attempts.withWatermark("started_at", late)
    return rows.groupBy("article_id").applyInPandasWithState(_absences(keep), ABSENCE, ABSENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
