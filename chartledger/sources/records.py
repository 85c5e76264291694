"""Read and write the record tables, rule tables, gold scripts, code systems and snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.config.rules import ESCALATION_RULES, QUESTIONS, label_of
from chartledger.config.vocabulary import (
    ANALYTES,
    CONSENT_SCOPES,
    POLICY,
    REPORT_VERSION,
    REQUIRED_SCOPES,
)
from chartledger.functions.text import fold_term
from chartledger.functions.values import VALUE_TYPE
from chartledger.sources.schemas import LAYOUT, TABLES


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table with a declared schema; only the declared columns are ever scanned."""
    return spark.read.schema(schema).parquet(path)


def read_records(spark: SparkSession, root: str, tables: list[str] | None = None
                 ) -> dict[str, DataFrame]:
    """The record tables under a root folder, one folder per table."""
    return {t: read_table(spark, f"{root}/{t}", TABLES[t]) for t in tables or TABLES}


def write_records(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Write a record table, clustered by its layout columns.

    Ranges over the key and a second column keep one large key from landing in one task or file,
    and let a reader skip files by the key.
    """
    keys = LAYOUT.get(table)
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df.write.mode(mode).parquet(f"{root}/{table}")


def rule_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed rule tables as small frames, one row per clause, option, alias or scope."""
    conditions = [
        (rid, level, label, i, path, op, [str(a) for a in arg] if isinstance(arg, list)
         else [str(arg)])
        for rid, level, label, clauses in ESCALATION_RULES
        for i, clause in enumerate(clauses) for path, op, arg in clause
    ]
    options = [
        (q[0], q[1], q[2], q[3], i, v, label_of(v), exclusive)
        for q in QUESTIONS for i, (v, exclusive) in enumerate(q[4])
    ]
    aliases = [(a[0], a[1], a[2], alias) for a in ANALYTES for alias in a[3]]
    scopes = [(s, s in REQUIRED_SCOPES) for s in CONSENT_SCOPES]
    policy = [(r, p, a) for r, d in POLICY["roles"].items() for p in d["purposes"]
              for a in d["actions"]]
    make = spark.createDataFrame
    return {
        "escalation": make(conditions, "rule_id string, level string, label string, clause int, "
                                       "path string, op string, args array<string>"),
        "option": make(options, "question_id string, section string, path string, kind string, "
                                "position int, value string, label string, exclusive boolean"),
        "analyte": make(aliases, "analyte_key string, display string, unit string, alias string"),
        "scope": make(scopes, "scope string, required boolean"),
        "policy": make(policy, "role string, purpose string, action string"),
    }


_GOLD = (
    "id string, title string, language string, difficulty string, "
    "turns array<struct<question_id:string,utterance:string,tap:variant,asr_confidence:double,"
    "decline:boolean>>, expected map<string,variant>, expected_red_flags array<string>, "
    "forbidden_red_flags array<string>, expected_priority string, expected_declined array<string>"
)


def variant_value(v: Column) -> Column:
    """A JSON value of any type as a fact value."""
    kind = F.schema_of_variant(v)
    as_list = kind.startswith("ARRAY")
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    name = (
        F.when(as_list, "list").when(kind == "BOOLEAN", "bool").when(number, "number")
        .otherwise("text")
    )
    made = F.struct(
        name.alias("kind"),
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("s"),
        F.when(number, F.try_variant_get(v, "$", "double")).alias("n"),
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).alias("b"),
        F.when(as_list, F.try_variant_get(v, "$", "array<string>")).alias("a"),
    )
    return F.when(v.isNotNull() & (kind != "VOID"), made.cast(VALUE_TYPE))


def parse_gold(scripts: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """Gold scripts held as JSON texts, one per row, as flat tables."""
    rows = scripts.select(F.from_json(text, _GOLD).alias("g")).select("g.*")
    fill = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    head = rows.select(
        F.col("id").alias("script_id"), "title", F.coalesce("language", F.lit("en"))
        .alias("language"), "difficulty", F.coalesce("expected_priority", F.lit("routine"))
        .alias("expected_priority"), fill("expected_red_flags"), fill("forbidden_red_flags"))
    turns = rows.select(F.col("id").alias("script_id"),
                        F.posexplode("turns").alias("turn", "t")).select(
        "script_id", "turn", "t.question_id", "t.utterance",
        variant_value(F.col("t.tap")).alias("tap"),
        F.coalesce("t.asr_confidence", F.lit(0.92)).alias("asr_confidence"),
        F.coalesce("t.decline", F.lit(False)).alias("decline"))
    slots = rows.select(F.col("id").alias("script_id"), F.explode("expected").alias("path", "_v")
                        ).select("script_id", "path", variant_value(F.col("_v")).alias("value"))
    declined = rows.select(F.col("id").alias("script_id"),
                           F.explode("expected_declined").alias("path"))
    return {"script": head, "turn": turns, "slot": slots, "declined": declined}


def read_gold(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Gold scripts from a folder of JSON files, one script per file."""
    return parse_gold(spark.read.text(f"{folder}/*.json", wholetext=True))


def load_code_systems(
    existing: DataFrame, incoming: DataFrame, concepts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(systems to add, concepts to add): what is not loaded yet, by (url, version).

    ``incoming`` holds url, version, name and payload (the text the checksum covers); ``concepts``
    url, version, code, display, class_kind, is_selectable. Loading twice adds nothing.
    """
    new = incoming.dropDuplicates(["url", "version"]).join(
        existing.select("url", "version"), ["url", "version"], "left_anti")
    systems = new.select("url", "version", "name", F.lit(True).alias("is_active"),
                         F.sha2("payload", 256).alias("checksum"))
    rows = concepts.join(new.select("url", "version"), ["url", "version"], "left_semi").withColumn(
        "display_normalized", fold_term(F.col("display")))
    return systems, rows


def make_snapshots(payloads: DataFrame, audience: str, version: str = REPORT_VERSION) -> DataFrame:
    """Frozen reports: encounter_id, payload, generated_at plus audience, version and a stable id."""
    key = F.concat_ws("|", F.col("encounter_id").cast("string"), F.lit(audience),
                      F.col("generated_at").cast("string"), F.sha2("payload", 256))
    return payloads.select(
        F.substring(F.sha2(key, 256), 1, 16).alias("snapshot_id"), "encounter_id",
        F.lit(audience).alias("audience"), F.lit(version).alias("report_version"),
        "generated_at", "payload")


def append_snapshots(snapshots: DataFrame, root: str) -> None:
    snapshots.write.mode("append").partitionBy("audience").parquet(f"{root}/report_snapshot")


def latest_snapshots(
    snapshots: DataFrame, audience: str, version: str = REPORT_VERSION
) -> DataFrame:
    """The newest snapshot of each encounter, and whether today's assembler wrote it."""
    newest = W.partitionBy("encounter_id").orderBy(F.desc("generated_at"), F.desc("snapshot_id"))
    rows = snapshots.filter(F.col("audience") == audience).withColumn(
        "_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return rows.withColumn("matches_current", F.col("report_version") == version)
