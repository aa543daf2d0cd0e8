"""Views and audits that stand on several record tables: squads, people, home venues, observations, issues, cases, moves.

Each table is grouped to its key before it is joined, so no join multiplies rows; where several rows of a key compete, the
docstring says which one is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_span


def squad(appearances: DataFrame, goals: DataFrame, register: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per season and person.

    appearances: season, person_key, match_id, name, role, day; goals: season, person_key; register: person_key, person_id,
    position; numbers: season, person_id, number. A person listed twice in a match appeared once, and started if any row
    says so. A key with several register rows takes that of the least person_id; of several numbers the least. Goals meet
    persons by key, not by the name shown. Rows without a person are left out.
    """
    each = appearances.filter("person_key IS NOT NULL").groupBy("season", "person_key", "match_id")
    once = each.agg(F.min("name").alias("name"), F.coalesce(F.bool_or(F.col("role") == "start"), F.lit(False)).alias("started"), F.min("day").alias("day"))
    rows = once.groupBy("season", "person_key").agg(
        F.min("name").alias("name"), F.count("*").alias("appearances"), F.count_if("started").alias("starts"), F.min("day").alias("first_match"), F.max("day").alias("last_match")
    )
    scored = goals.groupBy("season", "person_key").agg(F.count("*").alias("goals"))
    known = register.groupBy("person_key").agg(F.min(F.struct("person_id", "position")).alias("_known")).select("person_key", "_known.person_id", "_known.position")
    worn = numbers.groupBy("season", "person_id").agg(F.min("number").alias("number"))
    out = rows.join(known, "person_key", "left").join(worn, ["season", "person_id"], "left").join(scored, ["season", "person_key"], "left")
    return out.withColumn("goals", F.coalesce("goals", F.lit(0)))


def people(register: DataFrame, activity: DataFrame, roles: DataFrame) -> DataFrame:
    """Every registered person (person, name) with what is known of matches and roles.

    activity: person, season; roles: person, category, from_year, to_year. A role without a last year counts for its first.
    """
    played = activity.groupBy("person").agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("appearances"))
    years = roles.select("person", F.explode(year_span(F.col("from_year"), F.coalesce("to_year", "from_year"))).alias("year"))
    spans = years.groupBy("person").agg(F.count_distinct("year").alias("role_years"))
    held = roles.groupBy("person").agg(
        F.count("*").alias("role_count"), F.min("from_year").alias("first_role_year"), F.max(F.coalesce("to_year", "from_year")).alias("last_role_year"),
        F.array_sort(F.collect_set("category")).alias("role_categories"),
    )
    out = register.join(played, "person", "left").join(held, "person", "left").join(spans, "person", "left")
    return out.fillna(0, ["appearances", "role_count", "role_years"])


def home_venues(venues: DataFrame, matches: DataFrame) -> DataFrame:
    """Venues (venue, periods: array of struct(from_year, to_year)) that were ever a home, with all matches there and those
    within a home period. matches: venue, season. An open end lasts on."""
    homes = venues.filter(F.size("periods") > 0)
    counts = matches.groupBy("venue", "season").agg(F.count("*").alias("n"))
    inside = F.exists("periods", lambda p: (F.col("season") >= p["from_year"]) & (p["to_year"].isNull() | (F.col("season") <= p["to_year"])))
    joined = homes.join(counts, "venue", "left")
    return joined.groupBy("venue").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("home_matches"))


def observations(facts: DataFrame, relations: DataFrame, references: DataFrame, kinds: list[str]) -> DataFrame:
    """Facts with one sorted array of related ids for each kind, and the first address that is given.

    facts: fact, day; relations: fact, kind, ref; references: fact, position, url. A fact without relations has empty arrays.
    """
    sets = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("ref")))).alias(k) for k in kinds]
    related = relations.distinct().groupBy("fact").agg(*sets)
    address = references.filter("url IS NOT NULL").groupBy("fact").agg(F.min_by("url", F.struct("position", "url")).alias("first_url"))
    out = facts.join(related, "fact", "left").join(address, "fact", "left")
    return out.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in kinds})


def verified_issues(fragments: DataFrame) -> DataFrame:
    """What an issue proves, from its fragments: issue, fragment, evidence, same_fragment, phrase, printed, retrospective.

    The base is the best fragment with a printed score beside both names, else the best of all. A retrospective score loses
    its date. Without a score, a base that has no date takes it from the best dated fragment beside both names. Of equally
    strong fragments the first by name is the best.
    """
    order = F.struct((-F.col("evidence")).alias("_e"), "fragment")
    value = F.struct("fragment", "evidence", "phrase", "printed", "retrospective")
    beside = F.coalesce("same_fragment", F.lit(False))
    pick = lambda where: F.min_by(F.when(where, value), F.when(where, order))
    best = fragments.filter("evidence IS NOT NULL").groupBy("issue").agg(
        F.min_by(value, order).alias("_any"), pick(beside & F.col("phrase").isNotNull()).alias("_dated"), pick(beside & F.col("printed").isNotNull()).alias("_scored")
    )
    base = best.withColumn("_base", F.coalesce("_scored", "_any"))
    own = F.when(~F.coalesce("_base.retrospective", F.lit(False)) | F.col("_base.printed").isNull(), F.col("_base.phrase"))
    phrase = F.when(F.col("_scored").isNull() & F.col("_any.phrase").isNull(), F.coalesce("_dated.phrase", own)).otherwise(own)
    return base.select("issue", "_base.fragment", "_base.evidence", "_base.printed", phrase.alias("phrase"))


def closure(claims: DataFrame, *facts: DataFrame) -> DataFrame:
    """Where each claim stands. facts: tables of one row per claim that together hold canonical, has_candidates, review,
    community, resolution and eligibility; a claim absent from one has nothing of it."""
    out = claims
    for f in facts:
        out = out.join(f, "claim", "left")
    return out.select("claim", workflow().alias("workflow")).withColumn("terminal", F.when(~F.col("workflow").isin(*OPEN), F.col("workflow")))


OPEN = ("requires_revalidation", "needs_visual_review", "ready_for_canonicalization")


def workflow() -> Column:
    """The first state that applies."""
    is_ = lambda column, *values: F.coalesce(F.col(column).isin(*values), F.lit(False))
    return (
        F.when(is_("canonical", "canonicalized"), "canonicalized")
        .when(is_("canonical", "existing_match"), "matched_existing_canonical")
        .when(~F.coalesce("has_candidates", F.lit(False)), "no_candidate")
        .when(is_("review", "stale_review"), "requires_revalidation")
        .when(is_("community", "published", "unresolved"), "community_research")
        .when(F.col("review").isNull() | is_("review", "never_reviewed", "superseded_review"), "needs_visual_review")
        .when(is_("resolution", "different_event"), "rejected_different_event")
        .when(is_("resolution", "non_senior"), "rejected_non_senior")
        .when(is_("eligibility", "ready"), "ready_for_canonicalization")
        .when(is_("resolution", "insufficient"), "candidate_exhausted")
        .otherwise("visually_reviewed_unresolved")
    )


def generated_cases(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of each candidate: a new case, or why not. candidates: row, candidate, target, reviewable; existing: target.

    Of the reviewable rows of one candidate and target the first row counts; a target with a case made by hand keeps that.
    """
    usable = F.coalesce("reviewable", F.lit(False))
    first = candidates.filter(usable).groupBy(F.col("candidate").alias("_candidate"), F.col("target").alias("_target")).agg(F.min("row").alias("_first"))
    by_hand = existing.select("target").distinct().withColumn("_by_hand", F.lit(True))
    rows = candidates.join(first, F.expr("candidate <=> _candidate AND target <=> _target"), "left").join(by_hand, "target", "left")
    state = F.when(~usable, "not_reviewable").when(F.col("row") != F.col("_first"), "duplicate").when(F.col("_by_hand"), "manual_case_exists").otherwise("created")
    return rows.select("row", "candidate", "target", state.alias("state"))


def uncovered_mentions(mentions: DataFrame, observed: DataFrame) -> DataFrame:
    """Mentions (person, source, page) that no observation of the person covers by the same source and page; a page that is
    not given equals only a page that is not given."""
    names = ("person", "source", "page")
    seen = observed.select(*(F.col(c).alias(f"_{c}") for c in names)).distinct()
    return mentions.join(seen, F.expr(" AND ".join(f"{c} <=> _{c}" for c in names)), "left_anti")


#: Parts that coordinates are dealt over; by size alone, large parts of narrow rows would meet in one task.
PARTS = 96


def moved(old: DataFrame, new: DataFrame, moves: DataFrame) -> DataFrame:
    """Faults of a move of records to new coordinates, which must be one to one and keep every payload.

    old, new: coordinate, payload, one row per coordinate; moves: origin, target.
    """

    def unmatched(records: DataFrame, end: str, missing: str) -> DataFrame:
        rows = records.select(F.col("coordinate").alias("_at"), F.lit(True).alias("_is")).unionByName(moves.select(F.col(end).alias("_at"), F.lit(False).alias("_is")))
        each = rows.repartition(PARTS, "_at").groupBy("_at").agg(F.count_if("_is").alias("_is"), F.count_if(~F.col("_is")).alias("_n"))
        known, used, none = F.col("_is") > 0, F.col("_n") > 0, F.col("_at").isNull()
        faults = [F.when(F.col("_n") > 1, f"{end}_twice"), F.when(used & (~known | none), f"{end}_unknown"), F.when(known & (~used | none), missing)]
        return each.select(F.explode(F.array_compact(F.array(*faults))).alias("fault"), F.col("_at").cast("string").alias("about"))

    at = old.select(F.col("coordinate").alias("origin"), F.col("payload").alias("_old"))
    to = new.select(F.col("coordinate").alias("target"), F.col("payload").alias("_new"))
    dealt = lambda df, by: df.repartition(PARTS, by)
    both = dealt(dealt(moves, "origin").join(dealt(at, "origin"), "origin"), "target").join(dealt(to, "target"), "target")
    changed = both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.lit("payload_changed").alias("fault"), F.col("origin").cast("string").alias("about"))
    return unmatched(old, "origin", "not_moved").unionByName(unmatched(new, "target", "not_explained")).unionByName(changed)


def filled_profiles(register: DataFrame, found: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Registered rows whose missing fields are filled from what was found; nothing known is overwritten, and fields in which
    a found value differs are named. Of several found values the one first in ``order`` is taken, then the least."""
    firsts = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(order, f))).alias(f"_{f}") for f in fields]
    rows = register.join(found.groupBy(key).agg(*firsts), key, "left")
    differs = [F.when(F.col(f) != F.col(f"_{f}"), F.lit(f)) for f in fields]
    filled = {f: F.coalesce(f, f"_{f}") for f in fields}
    return rows.withColumn("conflicts", F.array_compact(F.array(*differs))).withColumns(filled).drop(*(f"_{f}" for f in fields))
