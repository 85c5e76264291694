"""Terminology: look terms up, code only exact matches, check codes."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.functions.text import fold_term
from chartledger.operators.containment import contained, containing, owners

EMITTABLE = "category"


def active_concepts(systems: DataFrame, concepts: DataFrame, system: str) -> DataFrame:
    """Concepts of the newest active version of a code system."""
    newest = (
        systems.filter((F.col("url") == system) & F.col("is_active"))
        .groupBy("url").agg(F.max_by("version", F.struct("created_on", "version")).alias("version"))
    )
    return concepts.join(newest, ["url", "version"], "left_semi")


def _grams(text: Column, n: int = 3) -> Column:
    """Every run of n letters, or the text itself when it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def _key_gram(text: Column) -> Column:
    """One run of letters, picked by hash so that common beginnings do not pile up."""
    hashed = F.transform(_grams(text), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
    return F.array_min(hashed)["g"]


def term_matches(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term_key, concept_id, code, display, rank): 0 exact, 1 the display contains the term,
    2 the term contains the display.

    Containment is found by an equi-join: if a text holds a shorter one, it holds any run of three
    letters of it. The shorter side offers one run, the longer side all of its runs, and the
    candidates are then checked in full. Displays under three letters meet the one- and two-letter
    runs of the terms in the same way. Distinct terms only, so a frequent term is matched once.
    """
    keys = terms.select(fold_term(F.col("term")).alias("term_key")).distinct().filter(
        F.length("term_key") >= 3)
    known = concepts.withColumn("_n", fold_term(F.col("display"))).filter("_n <> ''").select(
        "concept_id", "code", "display", "_n")
    inside = keys.withColumn("_g", _key_gram(F.col("term_key"))).join(
        known.withColumn("_g", F.explode(_grams(F.col("_n")))), "_g"
    ).filter(F.col("_n").contains(F.col("term_key")))
    every = F.array_union(
        _grams(F.col("term_key")),
        F.array_union(_grams(F.col("term_key"), 2), _grams(F.col("term_key"), 1)))
    around = keys.withColumn("_g", F.explode(every)).join(
        known.withColumn("_g", _key_gram(F.col("_n"))), "_g"
    ).filter(F.col("term_key").contains(F.col("_n")) & (F.col("term_key") != F.col("_n")))
    rank = F.when(F.col("_n") == F.col("term_key"), 0).otherwise(1)
    cols = ["term_key", "concept_id", "code", "display"]
    return inside.select(*cols, rank.alias("rank")).unionByName(
        around.select(*cols, F.lit(2).alias("rank"))).dropDuplicates(["term_key", "concept_id"])


def lookup_terms(terms: DataFrame, concepts: DataFrame, k: int = 5) -> DataFrame:
    """The k best concepts per distinct term: by rank, then concept order.

    Exact matches come first, by an equi-join; containment is searched only for terms that have
    fewer than k of them. Of a term's matches of one rank only the first k are ever made.
    """
    keys, shown = _term_keys(terms), _displays(concepts, k)
    exact = _exact(keys, shown)
    rest = keys.join(exact.filter(F.col("n") >= k), "term_key", "left_anti")
    found = [exact, containing(rest, shown, "term_key", "_n", k),
             contained(rest, shown, "term_key", "_n", k)]
    ranked = reduce(DataFrame.unionByName, [
        f.select("term_key", F.explode("first").alias("concept_id"), F.lit(r).alias("rank"))
        for r, f in enumerate(found)])
    # An exact match is among those that contain the term as well.
    ranked = ranked.groupBy("term_key", "concept_id").agg(F.min("rank").alias("rank"))
    best = W.partitionBy("term_key").orderBy("rank", "concept_id")
    top = ranked.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)
    return top.join(concepts.select("concept_id", "code", "display"), "concept_id").select(
        "term_key", "concept_id", "code", "display", "rank", "position")


def _term_keys(terms: DataFrame) -> DataFrame:
    return terms.select(fold_term(F.col("term")).alias("term_key")).distinct().filter(
        F.length("term_key") >= 3)


def _displays(concepts: DataFrame, k: int) -> DataFrame:
    """Different displays with the number of their concepts and the first k of these."""
    known = concepts.select("concept_id", fold_term(F.col("display")).alias("_n"))
    return owners(known.filter("_n <> ''"), "_n", "concept_id", k)


def _exact(keys: DataFrame, shown: DataFrame) -> DataFrame:
    return keys.join(shown, F.col("term_key") == F.col("_n")).select("term_key", "n", "first")


def code_terms(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Code each term by an exact match only; otherwise say how many were near and leave it.
    All near matches are counted, from the counts of runs of letters and not as pairs.

    Adds code, outcome (coded, not_emittable, near_matches, unmapped) and candidates.
    """
    keys, shown = _term_keys(terms), _displays(concepts, 1)
    kinds = concepts.select("concept_id", "class_kind", "is_selectable")
    ways = [_exact(keys, shown), containing(keys, shown, "term_key", "_n", 1),
            contained(keys, shown, "term_key", "_n", 1)]
    # Those that contain the term include the exact ones.
    counts = reduce(DataFrame.unionByName, [
        f.select("term_key", F.col("first")[0].alias("concept_id"), F.lit(r).alias("rank"),
                 (F.col("n") if r else F.lit(0).cast("long")).alias("n"))
        for r, f in enumerate(ways)]).groupBy("term_key").agg(
            F.sum("n").alias("candidates"), F.min_by("concept_id", "rank").alias("concept_id"),
            F.min("rank").alias("rank"))
    exact = counts.join(kinds, "concept_id", "left").join(
        concepts.select("concept_id", F.col("code").alias("_code")), "concept_id", "left")
    rows = terms.withColumn("term_key", fold_term(F.col("term"))).join(
        exact, "term_key", "left")
    emittable = (F.col("class_kind") == EMITTABLE) & F.col("is_selectable")
    outcome = (
        F.when(F.col("candidates").isNull(), "unmapped")
        .when(F.col("rank") > 0, "near_matches").when(~emittable, "not_emittable")
        .otherwise("coded")
    )
    return rows.select(
        *terms.columns, "term_key", outcome.alias("outcome"),
        F.when((F.col("rank") == 0) & emittable, F.col("_code")).alias("code"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def verify_codes(codes: DataFrame, systems: DataFrame, concepts: DataFrame) -> DataFrame:
    """ok, unknown_system, version_not_loaded, unknown_code or not_selectable for each code.

    ``codes`` holds url, version (null for the newest active one) and code.
    """
    loaded = systems.select("url", "version", "is_active", "created_on")
    newest = loaded.filter("is_active").groupBy("url").agg(
        F.max_by("version", F.struct("created_on", "version")).alias("_newest"))
    known = loaded.groupBy("url").agg(F.lit(True).alias("_known"))
    rows = codes.join(known, "url", "left").join(newest, "url", "left").withColumn(
        "_version", F.coalesce("version", "_newest"))
    have = loaded.select("url", F.col("version").alias("_version"), F.lit(True).alias("_loaded"))
    rows = rows.join(have.distinct(), ["url", "_version"], "left")
    entry = concepts.select("url", F.col("version").alias("_version"), "code", "class_kind",
                            "is_selectable", F.lit(True).alias("_found"))
    rows = rows.join(entry, ["url", "_version", "code"], "left")
    no = lambda c: F.col(c).isNull()
    status = (
        F.when(no("_known") | (no("_loaded") & no("version")), "unknown_system")
        .when(no("_loaded"), "version_not_loaded")
        .when(no("_found"), "unknown_code")
        .when((F.col("class_kind") != EMITTABLE) | ~F.col("is_selectable"), "not_selectable")
        .otherwise("ok")
    )
    return rows.select(*codes.columns, status.alias("status"))
