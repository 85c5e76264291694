"""Clinical views over the given tables.

The given tables hold no clinical records, so each query first reads them in a clinical shape.
A view is one SELECT in the common part of Spark SQL and ANSI SQL: the job runs it with Spark, and
the check runs the same text elsewhere, so both start from the same rows. Every view reads whole
tables; none keeps a subset.
"""

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _case(key: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


# The 16 slots a capture event can fill: path, kind, four texts.
SLOTS = (
    ("hpi.site", "text", ("chest", "abdomen", "head", "back")),
    ("hpi.onset", "text", ("sudden", "gradual", "after_event", "unsure")),
    ("hpi.severity", "number", ("9", "7", "4", "8")),
    ("hpi.associated", "list", ("sweating|breathlessness", "bleeding", "dizziness|fever", "none")),
    ("hpi.radiation", "text", ("left_arm", "jaw_neck", "back", "none")),
    ("hpi.exacerbating", "list", ("worse_effort", "worse_food|better_rest", "worse_lying",
                                  "nothing_helps")),
    ("review_of_systems.cardiovascular", "list",
     ("orthopnoea|ankle_swelling", "chest_pain_exertion", "palpitations", "none")),
    ("review_of_systems.neurological", "list",
     ("fits", "fainting|numbness", "neck_stiff", "none")),
    ("review_of_systems.gastrointestinal", "list",
     ("melaena", "weight_loss|nausea", "jaundice", "none")),
    ("review_of_systems.general", "list", ("weight_loss", "fever_persistent", "rash", "none")),
    ("review_of_systems.respiratory", "list",
     ("cough_3wk|night_sweats", "haemoptysis", "cough", "none")),
    ("personal_history.pregnancy", "text", ("yes", "maybe", "no", "na")),
    ("drug_allergy.taking_medicines", "bool", ("false", "true", "false", "true")),
    ("medications[0].name", "text", ("metformin", "amlodipine", "atorvastatin", "aspirin")),
    ("past_medical.conditions", "list", ("none", "diabetes|asthma", "hypertension", "none")),
    ("problems[1].reported_term", "text", ("type 2 diabetes", "asthma", "anaemia", "gout")),
)

_SLOT = "(k % 16)"
_PICK = "(event_id % 4)"
_PATH = _case(_SLOT, [s[0] for s in SLOTS])
_KIND = _case(_SLOT, [s[1] for s in SLOTS])
_TEXT = "CASE " + " ".join(
    f"WHEN {_SLOT} = {i} THEN {_case(_PICK, s[2])}" for i, s in enumerate(SLOTS)
) + " END"

_FEATURE_PATHS = (
    "chief_complaint.text", "hpi.site", "hpi.character", "hpi.radiation", "hpi.timing",
    "hpi.severity", "drug_allergy.taking_medicines",
)
_MED_NAME = "replace(p_name, ' ', '-')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (("events",), """
        SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
               CAST(user_id AS STRING) || '-' || CAST(extract(week FROM ts) AS STRING)
                   AS session_id
        FROM events"""),
    "patient": (("customer",), """
        SELECT c_custkey AS patient_id,
               CASE WHEN c_custkey % 3 = 0 THEN 'pat_guest_' ELSE 'pat_' END
                   || CAST(c_custkey AS STRING) AS patient_ref,
               CASE WHEN c_custkey % 5 = 0 THEN NULL
                    ELSE 'abha' || CAST(100000 + c_custkey AS STRING) END AS abha_ref,
               c_name AS display_name,
               c_mktsegment = 'BUILDING' AS is_synthetic,
               CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
               CAST(1940 + c_custkey % 70 AS INT) AS year_of_birth,
               DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS created_on
        FROM customer"""),
    "encounter": (("orders",), """
        SELECT o_orderkey AS encounter_id, o_custkey AS patient_id,
               CAST(o_orderdate AS DATE) AS occurred_on,
               CASE WHEN o_orderstatus = 'P' THEN 'document' ELSE 'intake' END AS kind,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'immediate' WHEN '2-HIGH' THEN 'urgent'
                    ELSE 'routine' END AS priority,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS headline,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ''
                    ELSE 'dr ' || CAST(o_orderkey % 20 AS STRING) END AS confirmed_by,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL
                    ELSE 'c' || CAST(o_orderkey AS STRING) END AS consent_ref,
               's' || CAST(o_orderkey AS STRING) AS session_ref
        FROM orders"""),
    "efact": (("lineitem",), f"""
        SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS encounter_id,
               {_case('(l_linenumber - 1)', _FEATURE_PATHS)} AS path,
               CASE WHEN l_linenumber = 7 THEN 'bool' WHEN l_linenumber = 4 THEN 'list'
                    ELSE 'text' END AS vkind,
               CASE WHEN l_linenumber = 7
                        THEN CASE WHEN max(l_partkey) % 2 = 0 THEN 'false' ELSE 'true' END
                    WHEN max(l_partkey) % 6 = 0 THEN 'none'
                    WHEN l_linenumber = 4 AND max(l_partkey) % 6 = 1 THEN 'v1|v2'
                    ELSE 'v' || CAST(max(l_partkey) % 6 AS STRING) END AS vs,
               CASE max(l_returnflag) WHEN 'A' THEN 'stated' WHEN 'N' THEN 'confirmed'
                    ELSE CASE max(l_suppkey) % 3 WHEN 0 THEN 'declined' WHEN 1 THEN 'not_asked'
                         ELSE 'document' END END AS state,
               CASE WHEN max(l_linestatus) = 'F' AND max(l_suppkey) % 4 = 0
                    THEN l_orderkey * 10 + l_linenumber + 1 END AS superseded_by,
               CASE WHEN max(l_suppkey) % 10 = 9 THEN 'withdrawn' END AS invalidated_reason,
               CAST(max(l_shipdate) AS DATE) AS recorded_on,
               max(l_suppkey) % 2 = 0 AS confirmed_by_physician
        FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "evidence": (("efact",), """
SELECT fact_id * 2 + 0 AS evidence_id, fact_id,
               CASE WHEN (fact_id + 0) % 3 = 0 THEN 'document' ELSE 'utterance' END
                   AS source_type,
               CASE WHEN (fact_id + 0) % 3 = 0 THEN NULL
                    WHEN (fact_id + 0) % 3 = 1 THEN 'touch' ELSE 'speech' END AS modality,
               'said ' || vs AS verbatim
        FROM efact WHERE fact_id % 5 <> 0
        UNION ALL
        SELECT fact_id * 2 + 1 AS evidence_id, fact_id,
               CASE WHEN (fact_id + 1) % 3 = 0 THEN 'document' ELSE 'utterance' END
                   AS source_type,
               CASE WHEN (fact_id + 1) % 3 = 0 THEN NULL
                    WHEN (fact_id + 1) % 3 = 1 THEN 'touch' ELSE 'speech' END AS modality,
               'said ' || vs AS verbatim
        FROM efact WHERE fact_id % 5 <> 0 AND fact_id % 4 = 0"""),
    "med": (("lineitem", "part", "orders"), f"""
        SELECT o_custkey AS patient_id, l_orderkey AS encounter_id, l_linenumber AS line_no,
               {_MED_NAME} AS name, p_name AS normalized_name,
               CAST(p_size AS STRING) || 'mg' AS dose,
               CASE l_returnflag WHEN 'A' THEN 'documented' WHEN 'R' THEN 'stopped-reported'
                    ELSE 'patient-reported-current' END AS status,
               CAST(l_shipdate AS DATE) AS observed_on
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        """),
    "obs": (("ev",), """
        SELECT event_id AS seq, user_id AS patient_id,
               CASE event_type WHEN 'click' THEN 'hba1c' WHEN 'view' THEN 'fasting_glucose'
                    WHEN 'purchase' THEN 'creatinine' WHEN 'error' THEN 'tsh' END AS analyte_key,
               CASE event_type WHEN 'click' THEN 'HbA1c' WHEN 'view' THEN 'Fasting glucose'
                    WHEN 'purchase' THEN 'Creatinine' WHEN 'error' THEN 'TSH'
                    ELSE 'Step Count' END AS display,
               CASE WHEN k % 17 = 0 THEN NULL ELSE value END AS value,
               CASE WHEN event_type = 'error' AND k % 29 = 0 THEN 'mIU/L' ELSE 'unit' END AS unit,
               CASE WHEN value > 100 THEN 'high' WHEN value < 5 THEN 'low' ELSE 'in_range' END
                   AS range_flag,
               CASE WHEN k % 19 = 0 THEN NULL ELSE day END AS observed_on
        FROM ev"""),
    "cand": (("ev",), f"""
        SELECT session_id, event_id AS seq, 'f' || CAST(event_id AS STRING) AS fact_id, ts,
               {_PATH} AS path, {_KIND} AS vkind,
               CASE WHEN event_id % 53 = 0 THEN NULL ELSE {_TEXT} END AS vs,
               CASE event_type WHEN 'error' THEN 'document' WHEN 'click' THEN 'confirmed'
                    WHEN 'purchase' THEN 'confirmed' ELSE 'stated' END AS tier,
               CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 61 = 0 THEN 'fax'
                    WHEN event_type = 'error' AND event_id % 43 <> 0 THEN 'document'
                    WHEN event_id % 71 = 0 THEN 'document' ELSE 'utterance' END AS span_kind,
               CASE WHEN event_id % 37 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN 'another matter'
                    ELSE 'I have ' || replace(replace({_TEXT}, '_', ' '), '|', ' and ') END
                   AS verbatim,
               CASE WHEN event_id % 41 = 0 THEN NULL ELSE 'q' || CAST({_SLOT} AS STRING) END
                   AS question_id,
               CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN {_TEXT} END AS selected,
               CASE event_type WHEN 'click' THEN 'touch' WHEN 'purchase' THEN 'typed'
                    ELSE 'speech' END AS modality,
               't' || CAST(k AS STRING) AS turn_id,
               CASE WHEN event_type = 'error' THEN 'd' || CAST(user_id AS STRING) END
                   AS document_id,
               CASE WHEN k % 7 = 0 THEN 'documents' WHEN k % 7 = 1 THEN 'voice' END
                   AS required_scope,
               event_type <> 'error' AS supersede
        FROM ev"""),
    "scope": (("ev",), """
        SELECT session_id,
               CASE WHEN min(user_id) % 3 = 0 THEN 'history|voice' WHEN min(user_id) % 3 = 1
                    THEN 'history|documents' ELSE 'history|voice|documents' END AS granted
        FROM ev GROUP BY session_id"""),
    "afact": (("sfact",), """
        SELECT *, coalesce(max(CASE WHEN supersede THEN seq END)
                           OVER (PARTITION BY session_id, path), -1) <= seq AS active
        FROM sfact"""),
    "sfact": (("cand",), """
        SELECT session_id, seq, fact_id, ts, path, vkind, vs, tier, verbatim, modality,
               document_id, supersede
        FROM cand WHERE vs IS NOT NULL"""),
    "absence": (("ev",), f"""
        SELECT session_id, event_id AS seq, {_case('((k + 5) % 16)', [s[0] for s in SLOTS])}
                   AS path,
               CASE event_id % 3 WHEN 0 THEN 'declined' WHEN 1 THEN 'not_asked'
                    ELSE 'declined' END AS reason
        FROM ev WHERE event_type = 'error' OR event_type = 'view'"""),
    "session": (("orders",), """
        SELECT 's' || CAST(o_orderkey AS STRING) AS session_ref, o_custkey AS patient_id,
               CAST(o_orderdate AS DATE) AS created_on,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) END AS expires_on,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 2 END AS purged_on,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'immediate' WHEN '2-HIGH' THEN 'urgent'
                    ELSE 'routine' END AS priority
        FROM orders"""),
    "audit": (("ev",), """
        SELECT event_id AS id, ts, 'u' || CAST(user_id AS STRING) AS actor, event_type AS action,
               CASE WHEN k % 9 = 0 THEN NULL ELSE 'c' || CAST(event_id % 5000 AS STRING) END
                   AS consent_ref,
               CAST(k AS STRING) AS detail
        FROM ev"""),
    "line": (("ev", "part"), f"""
        SELECT CAST(floor(event_id / 10) AS BIGINT) AS doc_id, 1 AS page,
               CAST(event_id % 10 AS INT) AS line_no, event_id,
               CASE k % 10
                    WHEN 0 THEN 'TAB. ' || upper({_MED_NAME}) || ' ' || CAST(p_size AS STRING)
                         || 'mg 1-0-1 x ' || CAST(k % 9 + 1 AS STRING) || ' days'
                    WHEN 1 THEN 'Cap ' || {_MED_NAME} || ' ' || CAST(p_size AS STRING)
                         || ' mg BD after food'
                    WHEN 2 THEN 'Syp. ' || {_MED_NAME} || ' 5 ml TDS for 2 weeks oral'
                    WHEN 3 THEN 'HbA1c: ' || CAST(value AS STRING) || ' % (4.0 - 5.6)'
                    WHEN 4 THEN 'Serum Creatinine - ' || CAST(value AS STRING) || ' mg/dL'
                    WHEN 5 THEN 'Date: ' || CAST(day AS STRING)
                    WHEN 6 THEN 'Diagnosis: ' || p_name || ' since 2015.'
                    WHEN 7 THEN 'Underwent ' || p_name || ' repair 12 Mar 2019'
                    WHEN 8 THEN 'Fasting plasma glucose ' || CAST(value AS STRING)
                         || ' mg/dL < 99'
                    ELSE 'Patient seen ' || substr(CAST(day AS STRING), 9, 2) || '/'
                         || substr(CAST(day AS STRING), 6, 2) || '/'
                         || substr(CAST(day AS STRING), 1, 4) || ' ' || p_brand END AS text,
               CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(52 + k % 75 AS DOUBLE) / 128 END
                   AS confidence,
               k % 13 = 0 AS handwritten
        FROM (SELECT ev.*, event_id % (SELECT count(*) FROM part) AS part_of FROM ev) spread
        JOIN part ON p_partkey = part_of"""),
    "truth": (("ev", "part"), f"""
        SELECT CAST(floor(event_id / 10) AS BIGINT) AS doc_id, event_id AS truth_id,
               CASE WHEN k % 10 <= 2 THEN 'medication' WHEN k % 10 = 6 THEN 'diagnosis'
                    ELSE 'investigation' END AS kind,
               CASE WHEN event_id % 7 = 0 THEN 'zzzzzzzzzzzzzz' WHEN k % 10 <= 2 THEN p_name
                    WHEN k % 10 = 6 THEN p_name || ' since' WHEN k % 10 = 3 THEN 'HbA1c'
                    WHEN k % 10 = 4 THEN 'Serum creatinine' ELSE 'Fasting glucose' END AS name,
               CASE WHEN k % 10 <= 1 THEN CAST(p_size AS STRING) || ' mg'
                    WHEN k % 10 = 2 THEN '9 ml' END AS dose,
               CASE WHEN k % 10 = 3 THEN 'high' WHEN k % 10 IN (4, 8) THEN 'in_range' END AS flag
        FROM (SELECT ev.*, event_id % (SELECT count(*) FROM part) AS part_of FROM ev) spread
        JOIN part ON p_partkey = part_of
        WHERE k % 10 IN (0, 1, 2, 3, 4, 6, 8)"""),
    "result": (("ev",), """
        SELECT event_id AS script_id, event_type AS difficulty, k % 20 <> 0 AS ok,
               CASE WHEN k % 4 = 0 THEN 'held' ELSE 'dev' END AS set_name,
               k % 12 AS facts_recorded, CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END
                   AS facts_without_source,
               CASE WHEN k % 17 = 0 THEN 2 ELSE 0 END AS unsourced_claims,
               CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'A|B' ELSE 'C' END AS expected_flags,
               CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A|B' WHEN 2 THEN 'C|D' ELSE '' END
                   AS fired_flags,
               CASE WHEN event_id % 8 = 2 THEN 'D' ELSE 'E' END AS forbidden_flags,
               CASE k % 3 WHEN 0 THEN 'routine' WHEN 1 THEN 'immediate' ELSE 'urgent' END
                   AS expected_priority,
               CASE event_id % 3 WHEN 0 THEN 'routine' WHEN 1 THEN 'immediate' ELSE 'urgent' END
                   AS actual_priority,
               k % 9 + 1 AS expected_slots, (k % 9 + 1) * (event_id % 2) AS matched_slots,
               CAST(k % 65 AS DOUBLE) / 64 AS completeness,
               CAST(floor(value) AS BIGINT) AS duration_ms
        FROM ev"""),
    "talk": (("conversations",), """
        SELECT conv_id, turn, role, text,
               CASE (conv_id + turn) % 5 WHEN 0 THEN 'hpi.site' WHEN 1 THEN 'hpi.associated'
                    WHEN 2 THEN 'med.taking' WHEN 3 THEN 'hpi.severity' ELSE 'cc.text' END
                   AS question_id,
               CASE WHEN (conv_id * 8 + turn) % 10 = 0 THEN NULL
                    ELSE CAST((conv_id * 37 + turn * 11) % 100 AS DOUBLE) / 100 END
                   AS asr_confidence
        FROM conversations"""),
}


def _needs(names: tuple[str, ...]) -> list[str]:
    """Views and tables needed for `names`, each after what it reads."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS.get(name, ((), ""))[0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_clause(names: tuple[str, ...], sf_dir: str | None = None,
                dealt: dict[str, str] | None = None) -> str:
    """The WITH list that defines `names`; given tables are read from `sf_dir` when it is set, and
    dealt over the partitions by the columns that ``dealt`` names."""
    parts = []
    for name in _needs(names):
        if name in VIEWS:
            parts.append(f"{name} AS ({VIEWS[name][1]})")
        elif sf_dir is not None:
            by = f"/*+ REPARTITION({dealt[name]}) */ " if name in (dealt or {}) else ""
            parts.append(f"{name} AS (SELECT {by}* FROM parquet.`{sf_dir}/{name}.parquet`)")
    return "WITH " + ",\n".join(parts)


class Views:
    """The clinical views and the given tables of one directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str,
                 dealt: dict[str, str] | None = None) -> None:
        self.spark, self.sf_dir, self._by = spark, sf_dir.rstrip("/"), dealt

    def dealt(self, **by: str) -> "Views":
        """The same views, for which given tables are shuffled by a column first: a view grouped by
        that column and others, and a join on it, take no shuffle of their own."""
        return Views(self.spark, self.sf_dir, by)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        clause = with_clause((name,), self.sf_dir, self._by)
        return self.spark.sql(f"{clause} SELECT * FROM {name}")


class Registry:
    """Named queries and the SQL each one is compared with."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, needs: str = "", sql: str | None = None):
        def keep(fn):
            self.queries[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
            if sql is not None:
                names = tuple(needs.split())
                clause = with_clause(names)
                body = sql.strip()
                if clause == "WITH ":
                    self.oracles[name] = body
                elif body.upper().startswith("WITH RECURSIVE "):
                    self.oracles[name] = "WITH RECURSIVE " + clause[5:] + ",\n" + body[15:]
                elif body.upper().startswith("WITH "):
                    self.oracles[name] = clause + ",\n" + body[5:]
                else:
                    self.oracles[name] = clause + "\n" + body
            return fn

        return keep
