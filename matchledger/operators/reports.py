"""Reports that find records which contradict each other, reviews and claims that no longer hold, and what to check next.

Persons' spells and roles are rows of (person, title, from_year, to_year); years are whole numbers. Each report is a join on
whole keys (person, season, claim), so a person or season with very many rows makes a large group of that key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import year_span
from ..functions.text import person_key


def less_precise(roles: DataFrame) -> DataFrame:
    """Titles of a person beside a longer title that begins with the same words in the same first year."""
    a = roles.select("person", "from_year", "title").distinct()
    b = a.select("person", "from_year", F.col("title").alias("beside"))
    longer = F.startswith(F.lower("beside"), F.concat(F.lower("title"), F.lit(" ")))
    return a.join(b, ["person", "from_year"]).filter(longer).select("person", "from_year", "title", "beside")


def sources_too_old(active: DataFrame, cited: DataFrame, slack: int = 5) -> DataFrame:
    """Sources of a person older by more than ``slack`` years than anything known of the person. active: person, year;
    cited: person, source, year."""
    earliest = active.groupBy("person").agg(F.min("year").alias("earliest"))
    return cited.join(earliest, "person").filter(F.col("year") < F.col("earliest") - slack).select("person", "source", "year", "earliest").distinct()


def other_coaches(roles: DataFrame, matches: DataFrame) -> DataFrame:
    """Coaches of a year in whose matches only others led. roles: person, year; matches: season, coach. Of equally frequent
    coaches the first by name is named."""
    led = matches.filter("coach IS NOT NULL").groupBy("season", "coach").agg(F.count("*").alias("n"))
    first = led.groupBy("season").agg(F.min_by("coach", F.struct((-F.col("n")).alias("_n"), "coach")).alias("known"), F.max("n").alias("known_matches"))
    rows = roles.select("person", F.col("year").alias("season")).distinct().join(first, "season")
    own = led.select("season", F.col("coach").alias("person"))
    return rows.join(own, ["season", "person"], "left_anti").select("person", "season", "known", "known_matches")


def outside_spell(spells: DataFrame, roles: DataFrame) -> DataFrame:
    """Years of roles that meet a declared spell of the person but reach beyond it, one row per spell."""
    s = spells.select("person", F.col("from_year").alias("spell_from"), F.col("to_year").alias("spell_to"), F.coalesce("to_year", "from_year").alias("_last"))
    r = roles.select("person", "title", "from_year", F.coalesce("to_year", "from_year").alias("_to"), year_span(F.col("from_year"), F.col("to_year")).alias("_years"))
    met = s.join(r, "person").filter((F.col("from_year") <= F.col("_last")) & (F.col("_to") >= F.col("spell_from")))
    outer = met.withColumn("_out", F.filter("_years", lambda y: ~y.between(F.col("spell_from"), F.col("_last"))))
    grouped = outer.groupBy("person", "spell_from", "spell_to").agg(F.array_join(F.sort_array(F.collect_set("title")), "/").alias("titles"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_out")))).alias("outside"))
    return grouped.filter(F.size("outside") > 0)


def suspicious_name(name: Column) -> Column:
    """Names that look misread: single letters without a full stop, brackets, long words in capitals."""
    tokens = F.split(name, "\\s+")
    single = F.exists(tokens, lambda t: (F.length(t) < 2) & ~F.endswith(t, F.lit(".")))
    capitals = F.exists(tokens, lambda t: (F.length(t) > 3) & (t == F.upper(t)))
    return single | name.rlike("[\\[\\]{}|<>]") | capitals


def candidates(conflicts: DataFrame, cases: DataFrame) -> DataFrame:
    """Undecided conflicts that no unfinished case covers, by urgency. conflicts: kind, ident, field, value, decision; cases:
    kind, ident, field, status."""
    key = ["kind", "ident", "field"]
    covered = cases.filter(F.col("status").isin("draft", "open", "paused")).select(*key).distinct()
    rows = conflicts.filter("decision = 'unresolved'").join(covered, key, "left_anti")
    about = F.col("field").rlike("(?i)^(name|wikidata|formann|styreleder|coach)")
    urgency = F.when(F.col("kind") == "person", F.when(about, 88).otherwise(72)).otherwise(F.when(F.col("field") == "score", 98).when(F.col("field") == "date", 92).otherwise(78))
    said = F.array_sort(F.collect_set(F.coalesce(F.col("value").cast("string"), F.lit("ukjent"))))
    return rows.groupBy(*key).agg(said.alias("values")).withColumn("urgency", urgency)


def review_validity(reviews: DataFrame, claims: DataFrame) -> DataFrame:
    """Whether reviews still hold for the claim they are matched with. reviews: review, asked (the claim's coordinate as text),
    claim_id, season, no, the last three as reviewed and null where not noted; claims: coordinate, claim_id, season, no."""
    now = claims.select(F.col("coordinate").alias("asked"), *(F.col(c).alias(f"_{c}") for c in ("claim_id", "season", "no")))
    state = (
        F.when(F.col("_claim_id").isNull(), "unknown_claim")
        .when(F.col("claim_id") != F.col("_claim_id"), "invalid")
        .when(F.col("season") != F.col("_season"), "requires_revalidation")
        .when(F.col("no") != F.col("_no"), "coordinate_changed_but_semantics_unchanged")
        .otherwise("valid")
    )
    return reviews.join(now, "asked", "left").select("review", state.alias("validity"))


def claim_integrity(claims: DataFrame, lineage: DataFrame, references: DataFrame) -> DataFrame:
    """Faults of claim ids, one row each: missing, of wrong form, used twice, a lineage that names no claim or another place,
    references to no claim. claims: claim_id, coordinate; lineage: claim_id, coordinate; references: claim_id, place."""
    fault = lambda rows, name, what: rows.select(F.lit(name).alias("fault"), F.col(what).cast("string").alias("about"))
    known = claims.filter("coalesce(claim_id, '') <> ''")
    form = known.filter(~F.col("claim_id").rlike("^srcclaim-[a-f0-9]{32}$"))
    counted = known.groupBy("claim_id").agg(F.count("*").alias("n"), F.min("coordinate").alias("coordinate"))
    traced = lineage.select("claim_id", F.col("coordinate").alias("_said")).join(counted, "claim_id", "left")
    lost = references.join(counted.select("claim_id"), "claim_id", "left_anti")
    return (
        fault(claims.filter("coalesce(claim_id, '') = ''"), "missing", "coordinate")
        .unionByName(fault(form, "form", "claim_id"))
        .unionByName(fault(counted.filter("n > 1"), "duplicate", "claim_id"))
        .unionByName(fault(traced.filter("n IS NULL"), "lineage_without_claim", "claim_id"))
        .unionByName(fault(traced.filter("n IS NOT NULL AND _said <> coordinate"), "lineage_elsewhere", "claim_id"))
        .unionByName(fault(lost, "reference_without_claim", "place"))
    )


def documented_years(seasons: DataFrame, claims: DataFrame) -> DataFrame:
    """Years with matches or with documented results only. seasons: season, played; claims: season, match_id, group_id,
    claim_id. A group of claims counts once, and not at all if one of it has a match."""
    linked = claims.filter("match_id IS NOT NULL AND group_id IS NOT NULL").select("group_id").distinct()
    loose = claims.filter("match_id IS NULL").join(linked, "group_id", "left_anti")
    results = loose.groupBy("season").agg(F.count_distinct(F.coalesce(F.concat(F.lit("g"), F.col("group_id")), F.concat(F.lit("c"), F.col("claim_id")))).alias("documented"))
    played = seasons.groupBy("season").agg(F.sum("played").alias("played"))
    return played.join(results, "season", "full_outer").select("season", F.coalesce("played", F.lit(0)).alias("played"), F.coalesce("documented", F.lit(0)).alias("documented"))


def extra_time(matches: DataFrame, goals: DataFrame) -> DataFrame:
    """Results after 90 minutes of matches that went on, from their goals. matches: match_id, home, away; goals: match_id,
    is_home, own_goal, minute (null: unreadable), shootout. Where goals don't add up to the result, it stays as it is."""
    for_home = F.when(F.col("own_goal"), ~F.col("is_home")).otherwise(F.col("is_home"))
    count = lambda side, more=F.lit(True): F.count_if(side & more)
    regular = F.col("minute") <= 90
    told = goals.filter("NOT shootout").groupBy("match_id").agg(count(for_home).alias("_h"), count(~for_home).alias("_a"), count(for_home, regular).alias("_h90"), count(~for_home, regular).alias("_a90"), F.count_if(F.col("minute").isNull()).alias("_bad"))
    rows = matches.join(told, "match_id", "left").na.fill(0, ["_h", "_a", "_h90", "_a90", "_bad"])
    state = F.when(F.col("_bad") > 0, "unreadable").when((F.col("_h") != F.col("home")) | (F.col("_a") != F.col("away")), "unexplained").otherwise("split")
    split = state == "split"
    later = split & ((F.col("home") > F.col("_h90")) | (F.col("away") > F.col("_a90")))
    return rows.select(
        "match_id", state.alias("state"), F.when(split, F.col("_h90")).otherwise(F.col("home")).cast("int").alias("home_score"), F.when(split, F.col("_a90")).otherwise(F.col("away")).cast("int").alias("away_score"),
        F.when(later, F.col("home") - F.col("_h90")).cast("int").alias("extra_home"), F.when(later, F.col("away") - F.col("_a90")).cast("int").alias("extra_away"),
    )


def shootouts(matches: DataFrame, shots: DataFrame) -> DataFrame:
    """Results of penalty shootouts: the summary's, else by counting shots, else the header's. matches: match_id, summary and
    header (arrays of two numbers or null); shots: match_id, is_home, scored."""
    counted = shots.groupBy("match_id").agg(F.count_if(F.col("is_home") & F.col("scored")).cast("int").alias("home"), F.count_if(~F.col("is_home") & F.col("scored")).cast("int").alias("away"))
    pair = lambda c: F.when((F.size(c) == 2) & F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull(), F.struct(F.get(c, F.lit(0)).cast("int").alias("home"), F.get(c, F.lit(1)).cast("int").alias("away")))
    best = F.coalesce(pair(F.col("summary")), F.when(F.col("home").isNotNull(), F.struct("home", "away")), pair(F.col("header")))
    return matches.join(counted, "match_id", "left").withColumn("_p", best).filter("_p IS NOT NULL").select("match_id", F.col("_p.home").alias("home"), F.col("_p.away").alias("away"))


def loose_names(people: DataFrame, entries: DataFrame) -> DataFrame:
    """An entry for each person: by the whole key of one of its names, else by first and last name if only one entry has
    them. people: person, name (a row per name); entries: entry, label. Of entries with one whole key the smallest is taken."""
    parts = lambda c: F.split(person_key(c), " ")
    ends = lambda c: F.when(F.size(parts(c)) < 2, person_key(c)).otherwise(F.concat_ws(" ", F.get(parts(c), F.lit(0)), F.element_at(parts(c), -1)))
    named = people.select("person", person_key(F.col("name")).alias("_key"), ends(F.col("name")).alias("_ends"))
    listed = entries.select("entry", person_key(F.col("label")).alias("_key"), ends(F.col("label")).alias("_ends"))
    exact = named.join(listed.groupBy("_key").agg(F.min("entry").alias("_exact")), "_key").groupBy("person").agg(F.min("_exact").alias("_exact"))
    # Two entries of one key tell that it isn't unique; the others needn't be listed.
    either = listed.groupBy("_ends").agg(F.min("entry").alias("_low"), F.max("entry").alias("_high"))
    loose = named.join(either, "_ends").groupBy("person").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    rows = people.select("person").distinct().join(exact, "person", "left").join(loose, "person", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_low") == F.col("_high"), "loose").when(F.col("_low").isNotNull(), "ambiguous").otherwise("none")
    return rows.select("person", how.alias("how"), F.when(how == "exact", F.col("_exact")).when(how == "loose", F.col("_low")).alias("entry"))


def batch_policy(hypotheses: DataFrame, group: list[str]) -> DataFrame:
    """Hypotheses alone in their group may be decided by themselves; siblings wait for a reviewer."""
    size = F.count("*").over(Window.partitionBy(*group))
    return hypotheses.withColumn("siblings", size).withColumn("policy", F.when(F.col("siblings") > 1, "manual").otherwise("automatic"))


#: Fixed value: the margin from which a result asks for a second look.
WIDE_MARGIN = 8


def doubtful_results(matches: DataFrame, margin: int = WIDE_MARGIN) -> DataFrame:
    """(match, margin, reason) of results with a wide margin: in a league, whose teams are near each other; elsewhere only if they are called confirmed on fewer than
    two providers. matches: match, home, away, competition_type, confidence and providers (array). Without both scores nothing is doubted; repeated providers
    count once."""
    wide = F.abs(F.col("home") - F.col("away"))
    alone = (F.col("confidence") == "confirmed") & (F.size(F.array_distinct(F.array_compact(F.coalesce("providers", F.array().cast("array<string>"))))) < 2)
    reason = F.when(F.col("competition_type") == "league", "league_margin").when(alone, "confirmed_by_one")
    return matches.withColumns({"margin": wide, "reason": reason}).filter((F.col("margin") >= margin) & F.col("reason").isNotNull()).select("match", "margin", "reason")
