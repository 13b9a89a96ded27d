"""Idempotent merges: upserts, refreshes, replacement, guards."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: dict[str, str] | None = None) -> DataFrame:
    """Rows of either side by key. For keys on both sides, a column is by default the new value; update names another rule:
    ``keep`` (old), ``fill`` (old unless null), ``new_known`` (new unless null). Nulls in keys equal each other."""
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    both = o.join(n, null_safe("o", "n", keys), "full")
    out = []
    for c in old.columns:
        rule = "key" if c in keys else (update or {}).get(c, "new")
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        merged = {"key": a, "new": b, "keep": a, "fill": F.coalesce(a, b), "new_known": F.coalesce(b, a)}[rule]
        out.append(F.when(F.col("o.__o").isNull(), b).when(F.col("n.__n").isNull(), a).otherwise(merged).alias(c))
    return both.select(*out)


def upsert_unless(old: DataFrame, new: DataFrame, keys: list[str], frozen: str) -> DataFrame:
    """Upsert that leaves rows alone whose ``frozen`` column is set."""
    f = old.select(*keys, F.col(frozen).alias("__f"))
    thawed = new.alias("n").join(f.filter("__f is not null").alias("f"), null_safe("n", "f", keys), "left_anti")
    return upsert(old, thawed, keys, {frozen: "keep"})


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows as they are, and new ones whose key is not there."""
    fresh = new.alias("n").join(old.select(*keys).alias("o"), null_safe("n", "o", keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str], keys: list[str]) -> DataFrame:
    """All rows of the parents that new names are replaced by its rows, one of each key."""
    stay = old.alias("o").join(new.select(*parent).distinct().alias("n"), null_safe("o", "n", parent), "left_anti")
    return stay.select(*old.columns).unionByName(new.dropDuplicates(keys).select(*old.columns))


def merge_and_prune(old: DataFrame, new: DataFrame, parent: list[str], keys: list[str], keep: list[str]) -> DataFrame:
    """Upsert that keeps some old columns, and drops rows that a parent's new version lacks; parents without new rows stay as they are."""
    named = new.select(*parent).distinct()
    untouched = old.alias("o").join(named.alias("n"), null_safe("o", "n", parent), "left_anti").select(*old.columns)
    o = old.select(*keys, *keep).alias("o")
    merged = new.alias("n").join(o, null_safe("n", "o", keys), "left")
    out = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in keep else F.col(f"n.{c}") for c in old.columns]
    return untouched.unionByName(merged.select(*out))


def delete_cascade(parents: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child that no deleted parent owns."""
    return child.join(parents.select(*keys).distinct(), keys, "left_anti")


def keep_lowest(df: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """One row of each key, nulls equal: the one with the lowest id. Partially aggregated, so a key with very many rows is no hot one."""
    first = df.groupBy(*keys).agg(F.min(id_).alias(id_)).select(id_)
    return df.join(first, id_, "left_semi")


def keep_newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows that none of the same key is newer than."""
    top = df.groupBy(*keys).agg(F.max(at).alias("__top"))
    return df.join(top, keys).filter(F.col(at) == F.col("__top")).drop("__top")


def regressed(old: Column, new: Column, least: int = 5, share: float = 0.5) -> Column:
    """Whether a new count is suspiciously low: the old one is over 5 and the new under half of it."""
    return (old > least) & (new < old * share)


def merge_participants(table: DataFrame, parsed: DataFrame) -> DataFrame:
    """Participants of two lists by normalised name: adjudicators win the role, institutions are filled."""
    t, p = table.alias("t"), parsed.alias("p")
    j = t.join(p, F.col("t.key").eqNullSafe(F.col("p.key")), "full")
    role = F.when((F.col("t.role") == "adjudicator") | (F.col("p.role") == "adjudicator"), "adjudicator").otherwise(F.coalesce("p.role", "t.role"))
    return j.select(F.coalesce("t.key", "p.key").alias("key"), role.alias("role"), F.coalesce("t.institution", "p.institution").alias("institution"))


def overwrite_blocked(counts: list[tuple[Column, Column]], known: Column, force: Column) -> Column:
    """Whether a new parse must not replace a stored tournament: one of its counts (old, new) fell suspiciously. A first parse and a forced
    one always go through; unknown counts are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return known & ~force & reduce(lambda x, y: x | y, (regressed(zero(a), zero(b)) for a, b in counts))


def cache_fresh(scraped_at: Column, now: Column, parser_current: Column, nav_rounds: Column, stored_rounds: Column, force: Column, days: int = 30) -> Column:
    """Whether a stored tournament may be served: younger than so many days, of the current parser, and with no more rounds announced than
    are stored (none announced says nothing)."""
    young = scraped_at > now - F.make_dt_interval(days=F.lit(days))
    return ~force & young & parser_current & ((nav_rounds == 0) | (nav_rounds <= stored_rounds))


def refreshed(tables: dict[str, DataFrame], tids: DataFrame) -> dict[str, DataFrame]:
    """What is left of a tournament's tables before a new parse is written: elimination, team_result, judge_assignment, speaker_score, role
    and participant. Leaves go, but for judging known from private pages; a participant goes whose person nobody has claimed and who
    never judged there. participant: (participant_id, tid, person_id, claimed); scores and roles belong to a participant."""
    t = tids.select("tid").distinct()
    of = tables["participant"].join(t, "tid", "left_semi")
    ids = of.select("participant_id")
    judged = tables["judge_assignment"].select("tid", "person_id").distinct()
    gone = of.filter("claimed is null").join(judged, ["tid", "person_id"], "left_anti").select("participant_id")
    without = lambda name, keys, on: tables[name].join(keys, on, "left_anti")
    panels = tables["judge_assignment"].join(t.withColumn("source", F.lit("round_results")), ["tid", "source"], "left_anti")
    return {
        "elimination": without("elimination", t, "tid"), "team_result": without("team_result", t, "tid"), "judge_assignment": panels,
        "speaker_score": without("speaker_score", ids, "participant_id"), "role": without("role", ids, "participant_id"), "participant": without("participant", gone, "participant_id"),
    }


TARGET = ["user_id", "kind", "tid", "motion_id"]


def accepted_proposals(requests: DataFrame, vocabulary: DataFrame, owned: DataFrame, motion: DataFrame) -> DataFrame:
    """The requests that may become proposals, the last of each target: a value of the kind's vocabulary, a region without a motion or a
    motion of the tournament, and a tournament that the user has ingested. requests: (seq, proposal_id, user_id, kind, tid, motion_id, value)."""
    known = requests.join(vocabulary.select("kind", "value").distinct(), ["kind", "value"], "left_semi").join(owned.select("user_id", "tid").distinct(), ["user_id", "tid"], "left_semi")
    plain = known.filter("kind = 'region' and motion_id is null")
    moved = known.filter("kind <> 'region'").join(motion.select("tid", "motion_id").distinct(), ["tid", "motion_id"], "left_semi")
    columns = [F.max_by(c, "seq").alias(c) for c in ("proposal_id", "value")]
    return plain.unionByName(moved).groupBy(*TARGET).agg(*columns)


def propose_tags(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """One live proposal for each target: the first there is takes the new value and is pending again, unreviewed; others are added."""
    a = accepted.withColumn("__a", F.lit(True)).alias("a")
    first = proposals.groupBy(*TARGET).agg(F.min("proposal_id").alias("__first"))
    marked = proposals.alias("p").join(first.alias("f"), null_safe("p", "f", TARGET)).select("p.*", (F.col("p.proposal_id") == F.col("f.__first")).alias("__is"))
    j = marked.alias("p").join(a, null_safe("p", "a", TARGET) & F.col("p.__is"), "left")
    again = F.col("a.__a").isNotNull()
    reset = {"value": F.col("a.value"), "status": F.lit("pending"), "note": F.lit(None), "reviewed_at": F.lit(None)}
    kept = j.select(*[F.when(again, reset[c]).otherwise(F.col(f"p.{c}")).alias(c) if c in reset else F.col(f"p.{c}") for c in proposals.columns])
    fresh = accepted.alias("n").join(first.alias("f"), null_safe("n", "f", TARGET), "left_anti")
    blank = {"status": F.lit("pending"), "note": F.lit(None), "reviewed_at": F.lit(None)}
    return kept.unionByName(fresh.select(*[(blank[c].cast(proposals.schema[c].dataType) if c in blank else F.col(c)).alias(c) for c in proposals.columns]))


@dataclass(frozen=True)
class Link:
    """A foreign key: rows of ``child`` whose ``column`` names a deleted row (``key``) of ``parent`` go as well, or lose the reference."""

    child: str
    column: str
    parent: str
    key: str
    set_null: tuple[str, ...] = ()  # the columns that are emptied instead


def cascade(tables: dict[str, DataFrame], links: list[Link], root: str, key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after the rows of ``root`` whose ``key`` is in ``gone`` are deleted. links: parents before their children."""
    first = tables[root].join(gone.select(key).distinct(), key, "left_semi")
    deleted, out = {root: first}, {**tables, root: tables[root].join(gone.select(key).distinct(), key, "left_anti")}
    for x in links:
        if x.parent not in deleted:
            continue
        keys = deleted[x.parent].select(F.col(x.key).alias(x.column)).filter(F.col(x.column).isNotNull()).distinct()
        if x.set_null:
            hit = out[x.child].join(keys.withColumn("__gone", F.lit(True)), x.column, "left")
            empty = {c: F.when(F.col("__gone").isNull(), F.col(c)) for c in x.set_null}
            out[x.child] = hit.withColumns(empty).select(tables[x.child].columns)
            continue
        more = out[x.child].join(keys, x.column, "left_semi")
        deleted[x.child] = deleted[x.child].unionByName(more) if x.child in deleted else more
        out[x.child] = out[x.child].join(keys, x.column, "left_anti").select(tables[x.child].columns)
    return out


def confirmed(requests: DataFrame, users: DataFrame) -> DataFrame:
    """The users who ask for their deletion under their own address. requests: (user_id, confirm), users: (user_id, email)."""
    j = requests.join(users, "user_id")
    return j.filter(F.lower(F.trim("confirm")) == F.lower(F.coalesce("email", F.lit("")))).select("user_id").distinct()


def released_claims(persons: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons without the claims that are to be released, a notification for each former holder); unclaimed ones are left as they are."""
    asked = requests.select("person_id").distinct()
    told = persons.join(asked, "person_id", "left_semi").filter("claimed_by is not null")
    title = F.concat(F.lit('"'), "name", F.lit('" was removed from your record'))
    hit = persons.join(asked.withColumn("__asked", F.lit(True)), "person_id", "left")
    after = hit.withColumns({c: F.when(F.col("__asked").isNull(), F.col(c)) for c in ("claimed_by", "claimed_at")}).select(persons.columns)
    return after, told.select(F.col("claimed_by").alias("user_id"), F.lit("identity_released").alias("kind"), title.alias("title"))
