"""Review cases, their decisions and candidates, and the queue of jobs, as tables of events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import first_match
from tallyforge.operators.quality import review_order
from tallyforge.operators.relational import contains_text, latest_by

#: Decisions that need a comment, and that which needs a registry product.
NEED_COMMENT, NEEDS_TARGET = ("MANUAL_CONFIRMED_NEW", "MANUAL_ACCESSORY"), "MANUAL_CONFIRMED"


def case_listing(cases: DataFrame, equal: dict[str, object] | None = None, containing: dict[str, str] | None = None, opened: tuple[str | None, str | None] = (None, None), limit: int = 200) -> DataFrame:
    """Cases that pass the filters that are set: equal columns, contained texts, days of opening; in the order of work."""
    for column, value in (equal or {}).items():
        if value not in (None, ""):
            cases = cases.filter(F.col(column) == value)
    for column, text in (containing or {}).items():
        if text:
            cases = cases.filter(contains_text([column], text))
    for day, later in zip(opened, (True, False), strict=True):
        if day:
            at = F.to_date("opened_at")
            cases = cases.filter(at >= F.to_date(F.lit(day)) if later else at <= F.to_date(F.lit(day)))
    return cases.orderBy(*review_order()).limit(limit)


def case_counts(cases: DataFrame) -> DataFrame:
    """One row of counters over the cases."""
    open_ = F.col("status") != "RESOLVED"
    tests = {
        "open": open_, "resolved": ~open_, "postponed": F.col("status") == "POSTPONED", "reopened": F.col("status") == "REOPENED_SOURCE_CHANGED",
        "conflicts": open_ & (F.col("decision") == "CONFLICT"), "new_candidates": open_ & (F.col("decision") == "SAFE_NEW_PRODUCT_CANDIDATE"),
    }
    return cases.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def search_candidates(registry: DataFrame, text: str, rejected: DataFrame, columns: Sequence[str] = ("key", "name", "brand", "model", "article"), limit: int = 50) -> DataFrame:
    """Active registry products in which the text occurs, whatever the case, without the rejected ones; by name and key."""
    hits = registry.filter(F.col("active") & contains_text(list(columns), text.strip()))
    return hits.join(rejected.select("key").distinct(), "key", "left_anti").orderBy("name", "key").limit(limit)


def comparison(cases: DataFrame, key: str, pairs: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """A row per case and label: both sides, and whether they agree. pairs: source, candidate, equality by label."""
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    entries = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.coalesce(F.nullif(a, F.lit("")), F.lit("—")).alias("source"), F.coalesce(F.nullif(b, F.lit("")), F.lit("—")).alias("candidate"),
            F.when(empty(a) | empty(b), "NO_DATA").when(F.coalesce(same, F.lit(False)), "EQUAL").otherwise("CONFLICT").alias("state"),
        )
        for label, (a, b, same) in pairs.items()
    ])
    return cases.select(key, F.explode(entries).alias("x")).select(key, "x.*")


def decide_cases(cases: DataFrame, asked: DataFrame, registry: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, next cases): what becomes of asked decisions (case_id, user_id, decision, target, comment).

    A problem keeps a decision from taking effect: an unknown case, a comment or target that is missing,
    a target that is not an active registry product, a source with another link, or a link that another
    source of the supplier has already. POSTPONED leaves a case open. cases: case_id, source_key, status,
    decision_class; sources: source_key, supplier, linked.
    """
    rows = asked.join(cases.select("case_id", "source_key"), "case_id", "left").join(registry.filter("active").select(F.col("key").alias("target"), F.lit(True).alias("_known")), "target", "left")
    rows = rows.join(sources, "source_key", "left")
    taken = sources.filter("linked is not null").select("supplier", F.col("linked").alias("target"), F.col("source_key").alias("_other")).groupBy("supplier", "target").agg(F.min("_other").alias("_least"), F.max("_other").alias("_most"))
    rows = rows.join(taken, ["supplier", "target"], "left")
    confirms, blank = F.col("decision") == NEEDS_TARGET, F.trim(F.coalesce("comment", F.lit(""))) == ""
    problem = first_match([
        (F.col("source_key").isNull(), F.lit("UNKNOWN_CASE")), (F.col("decision").isin(*NEED_COMMENT) & blank, F.lit("COMMENT_REQUIRED")), (confirms & F.col("target").isNull(), F.lit("TARGET_REQUIRED")),
        (F.col("target").isNotNull() & F.col("_known").isNull(), F.lit("TARGET_NOT_ACTIVE")), (confirms & F.col("linked").isNotNull() & (F.col("linked") != F.col("target")), F.lit("CONTRADICTS_LINK")),
        (confirms & ((F.col("_least") != F.col("source_key")) | (F.col("_most") != F.col("source_key"))), F.lit("TARGET_TAKEN")),
    ])
    decisions = rows.select("case_id", "source_key", "user_id", "decision", "target", "comment", problem.alias("problem"))
    valid = decisions.filter("problem is null").groupBy("case_id").agg(F.max(F.struct("user_id", "decision")).alias("x"))
    status = F.when(F.col("x").isNull(), F.col("status")).when(F.col("x.decision") == "POSTPONED", "POSTPONED").otherwise("RESOLVED")
    final = F.when(F.col("x").isNull(), F.col("decision_class")).when(F.col("x.decision") != "POSTPONED", F.col("x.decision"))
    after = cases.join(valid, "case_id", "left").select("case_id", "source_key", status.alias("status"), final.alias("decision_class"))
    return decisions, after


def assign_cases(cases: DataFrame, ids: DataFrame, user: int | None) -> DataFrame:
    """Cases with those among ids given to a user; resolved ones stay, open ones become assigned."""
    rows = cases.join(ids.select("case_id", F.lit(True).alias("_mine")), "case_id", "left")
    moves = F.coalesce("_mine", F.lit(False)) & (F.col("status") != "RESOLVED")
    made = {"assignee": F.when(moves, F.lit(user).cast("bigint")).otherwise(F.col("assignee")), "status": F.when(moves & (F.col("status") == "OPEN"), "ASSIGNED").otherwise(F.col("status"))}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in cases.columns])


def case_history(decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """What was done with each case, newest first: decisions and rejected candidates."""
    a = decisions.select("case_id", "at", "event_id", F.lit("DECISION").alias("what"), F.col("decision").alias("detail"), "user_id")
    b = rejections.select("case_id", "at", "event_id", F.lit("REJECTION").alias("what"), F.col("candidate").alias("detail"), "user_id")
    return a.unionByName(b).orderBy("case_id", F.desc("at"), F.desc("event_id"))


# The queue of jobs


def enqueue(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked jobs (supplier, trigger) with the open job that already serves the supplier, if any; only others are new."""
    open_ = jobs.filter("status in ('queued', 'running')").groupBy("supplier").agg(F.min("job_id").alias("existing_job"))
    return asked.groupBy("supplier").agg(F.min("trigger").alias("trigger")).join(open_, "supplier", "left").withColumn("enqueued", F.col("existing_job").isNull())


def claim(jobs: DataFrame, slots: int) -> DataFrame:
    """The queued jobs that may start: one per domain that no running job works on, the oldest first, `slots` at most."""
    busy = jobs.filter("status = 'running'").select("domain").distinct()
    free = latest_by(jobs.filter("status = 'queued'").join(busy, "domain", "left_anti").select("domain", "job_id", "queued_at"), ["domain"], ["queued_at", "job_id"], earliest=True)
    return free.orderBy("queued_at", "job_id").limit(slots)


def recover_stale(jobs: DataFrame, as_of: Column, most_attempts: int = 3) -> DataFrame:
    """Running jobs whose lease is over go back to the queue, or fail when they have been tried often enough."""
    stale = (F.col("status") == "running") & (F.col("lease_expires_at") < as_of)
    again = F.when(F.col("attempts") >= most_attempts, "failed").otherwise("queued")
    return jobs.withColumns({"stale": F.coalesce(stale, F.lit(False)), "status": F.when(stale, again).otherwise(F.col("status"))})


def domain_of(url: Column) -> Column:
    """The host in lower case without www. and dots at the end; null without a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def lock_key(domain: Column) -> Column:
    """The first 64 bits of the domain's SHA-256, as a signed number."""
    digits = F.substring(F.sha2(domain, 256), 1, 16)
    half = lambda a: F.conv(F.substring(digits, a, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


# Schedules, on the driver: a supplier has one


def _field(text: str, low: int, high: int) -> set[int]:
    found: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
        if not low <= first <= last <= high or (step and int(step) < 1):
            raise ValueError(f"invalid cron field {text}")
        found.update(range(first, last + 1, int(step or 1)))
    return found


def occurrences(expression: str, zone: str, after: datetime, count: int = 3, back: bool = False) -> list[datetime]:
    """The next (or, back, the last) times of a cron expression of five fields in a time zone, as UTC.

    Where both day fields are restricted either may hold; times that a change of clocks skips don't occur.
    """
    fields = expression.split()
    if len(fields) != 5 or after.tzinfo is None:
        raise ValueError("a cron expression has five fields, and the time a zone")
    minutes, hours, days, months, weekdays = (_field(f, *span) for f, span in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    weekdays |= {0} if 7 in weekdays else set()
    either = fields[2] != "*" and fields[4] != "*"
    local = ZoneInfo(zone)
    step = timedelta(days=-1 if back else 1)
    day, found = after.astimezone(local).date(), []
    for _ in range(366 * 28 + 1):
        fits = (day.day in days, (day.isoweekday() % 7) in weekdays)
        if day.month in months and (any(fits) if either else all(fits)):
            times = sorted((datetime(day.year, day.month, day.day, h, m, tzinfo=local) for h in hours for m in minutes), reverse=back)
            for at in times:
                utc = at.astimezone(ZoneInfo("UTC"))
                if utc.astimezone(local).replace(tzinfo=None) == at.replace(tzinfo=None) and (utc <= after if back else utc > after):
                    found.append(utc)
                    if len(found) == count:
                        return found
        day += step
    return found


def due(schedules: Sequence[tuple[str, str, str, datetime | None]], now: datetime, grace: float = 60.0) -> list[tuple[str, datetime]]:
    """(supplier, occurrence) of schedules (supplier, cron, zone, last enqueued) that are due within the grace and not enqueued yet."""
    found = []
    for supplier, expression, zone, last in schedules:
        at = next(iter(occurrences(expression, zone, now, 1, back=True)), None)
        if at and (now - at).total_seconds() <= grace and (last is None or at > last):
            found.append((supplier, at))
    return found
