"""Queries over conversation turns as answers."""

from pyspark.sql import functions as F

from chartledger.config.rules import QUESTIONS
from chartledger.config.vocabulary import NEGATORS
from chartledger.operators import utterances as U
from chartledger.plans.bindings import Registry

REG = Registry()
query = REG.add

# Phrases made of words that are frequent in the given conversations.
LEXICON = {
    "hpi.site": {"head": ["the in", "le"], "chest": ["and", "de la"], "abdomen": ["to", "que"],
                 "back": ["that it", "un"], "limbs": ["der", "of"], "joints": ["on"]},
    "hpi.associated": {"none": ["in"], "fever": ["the", "la"], "vomiting": ["et", "it is"],
                       "sweating": ["er", "on"], "dizziness": ["to"], "bleeding": ["und"]},
    "cc.text": {"pain": ["the"], "fever": ["la"], "cough": ["der"], "skin": ["that"]},
}
_ASKED = [q for q in QUESTIONS if q[0] in ("hpi.site", "hpi.associated", "cc.text")]


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_PH = "ph(question_id, option, oord, negatable, phrase, score, bucket, rank) AS (VALUES " + ", ".join(
    f"('{q[0]}', '{r[0]}', {r[1]}, {str(r[2]).lower()}, {_q(r[3])}, CAST({r[4]!r} AS DOUBLE), "
    f"{r[5]}, {r[6]})" for q in _ASKED for r in U.phrase_rows(q, LEXICON)) + ")"
_CUT = "win"
for _b in (";", " but ", " however ", " aur ", " and "):
    _CUT = f"regexp_replace({_CUT}, '(?s)^.*{_b}', '')"
_NEG = "[" + ", ".join(_q(n) for n in NEGATORS) + "]"
_HITS = "WITH " + _PH + f"""
, u AS (SELECT * FROM talk),
f AS (SELECT u.conv_id, u.turn, u.question_id, ph.*, strpos(lower(text), phrase) - 1 AS start,
   text FROM u JOIN ph ON ph.question_id = u.question_id
   WHERE strpos(lower(text), phrase) > 0),
w AS (SELECT * EXCLUDE (question_id_1), substr(lower(text), CAST(greatest(start - 24, 0) + 1 AS INT),
   CAST(least(start, 24) AS INT)) AS win FROM f),
ok AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, option ORDER BY rank) AS rn FROM w
  WHERE NOT negatable OR NOT list_has_any(list_slice(list_reverse(
    regexp_extract_all({_CUT}, '[\\p{{L}}\\p{{N}}_'']+')), 1, 4), {_NEG})),
hit AS (SELECT *, substr(text, CAST(start + 1 AS INT), length(phrase)) AS quote,
   row_number() OVER (PARTITION BY conv_id, turn ORDER BY bucket DESC, start, oord) AS pos
   FROM ok WHERE rn = 1)
"""


@query("x13_match_options", "talk", _HITS + """
SELECT conv_id, turn, option, quote, round(score, 4) AS score, CAST(start AS INT) AS start,
  CAST(pos AS INT) AS position FROM hit""")
def _(v):
    rows = U.match_options(v.talk, LEXICON, _ASKED)
    return rows.select("conv_id", "turn", F.posexplode("hits").alias("p", "h")).select(
        "conv_id", "turn", F.col("h.value").alias("option"), "h.quote",
        F.round("h.score", 4).alias("score"), "h.start", (F.col("p") + 1).alias("position"))


def _word(cue):
    return f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){cue}($|[^\\p{{L}}\\p{{N}}_])')"


def _cues(cues):
    return "CASE " + " ".join(
        f"WHEN {_word(c)} THEN '{c}'" for c in sorted(cues, key=len, reverse=True)) + " END"


_SLOTS = _HITS + f"""
, top AS (SELECT conv_id, turn, arg_min(option, pos) AS option, arg_min(quote, pos) AS quote,
    arg_min(score, pos) AS score FROM hit GROUP BY 1, 2),
many AS (SELECT conv_id, turn, string_agg(option, '|' ORDER BY pos) AS vals, min(score) AS score,
    min(strpos(lower(text), lower(quote))) AS s,
    max(strpos(lower(text), lower(quote)) + length(quote)) AS e
    FROM hit WHERE option <> 'none' GROUP BY 1, 2),
cue AS (SELECT *, {_cues(U.NO_CUES)} AS no_cue, {_cues(U.YES_CUES)} AS yes_cue,
    regexp_extract(text, '\\b(10|[0-9])\\b', 1) AS digit,
    regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole FROM talk),
slot AS (
  SELECT c.conv_id, c.turn, c.question_id, c.asr_confidence, c.text,
   CASE question_id WHEN 'hpi.site' THEN t.option WHEN 'hpi.associated' THEN m.vals
     WHEN 'med.taking' THEN CASE WHEN no_cue IS NOT NULL THEN 'false' WHEN yes_cue IS NOT NULL
          THEN 'true' END
     WHEN 'hpi.severity' THEN CASE WHEN digit <> '' THEN digit END
     ELSE coalesce(t.option, CASE WHEN whole <> '' THEN whole END) END AS value_text,
   CASE question_id WHEN 'hpi.site' THEN t.quote
     WHEN 'hpi.associated' THEN substr(text, CAST(s AS INT), CAST(e - s AS INT))
     WHEN 'med.taking' THEN substr(text, strpos(lower(text), coalesce(no_cue, yes_cue)),
          length(coalesce(no_cue, yes_cue)))
     WHEN 'hpi.severity' THEN digit ELSE coalesce(t.quote, whole) END AS quote,
   CASE question_id WHEN 'hpi.site' THEN t.score WHEN 'hpi.associated' THEN m.score
     WHEN 'med.taking' THEN 0.8 WHEN 'hpi.severity' THEN 0.75
     ELSE coalesce(t.score, 0.9) END AS confidence
  FROM cue c LEFT JOIN top t USING (conv_id, turn) LEFT JOIN many m USING (conv_id, turn))
"""


def slots(v):
    return U.extract_slots(v.talk, LEXICON)


@query("x14_extract_slots", "talk", _SLOTS + """
SELECT conv_id, turn, question_id, md5(value_text) AS value_hash, md5(quote) AS quote_hash,
  round(confidence, 4) AS confidence FROM slot WHERE value_text IS NOT NULL""")
def _(v):
    return slots(v).select("conv_id", "turn", "question_id", F.md5("value_text").alias("value_hash"),
                           F.md5("quote").alias("quote_hash"),
                           F.round("confidence", 4).alias("confidence"))


_VERIFIED = _SLOTS + """
, ver AS (SELECT *, CASE WHEN strpos(lower(text), lower(CASE WHEN (conv_id + turn) % 11 = 3
        THEN quote || '#never#' ELSE quote END)) = 0 THEN 'unquoted'
     WHEN (conv_id + turn) % 13 = 4 AND question_id = 'hpi.site' THEN 'bad_value'
     ELSE 'proposed' END AS outcome,
   least(confidence, CASE WHEN asr_confidence > 0 THEN asr_confidence ELSE 1.0 END) AS conf
   FROM slot WHERE value_text IS NOT NULL)
"""


def verified(v):
    rows = slots(v).withColumns({
        "quote": F.expr("CASE WHEN (conv_id + turn) % 11 = 3 THEN quote || '#never#' "
                        "ELSE quote END"),
        "value_text": F.expr("CASE WHEN (conv_id + turn) % 13 = 4 AND question_id = 'hpi.site' "
                             "THEN 'elsewhere' ELSE value_text END"),
    })
    return U.verify_slots(rows)


@query("x15_verify_slots", "talk", _VERIFIED + """
SELECT conv_id, turn, outcome, round(conf, 4) AS confidence FROM ver""")
def _(v):
    return verified(v).select("conv_id", "turn", "outcome",
                              F.round("confidence", 4).alias("confidence"))


@query("x15_slot_counts", "talk", _VERIFIED + """
SELECT question_id, CAST(count(*) AS BIGINT) AS proposed,
  CAST(count(*) FILTER (outcome = 'proposed') AS BIGINT) AS verified,
  CAST(count(*) FILTER (outcome = 'unquoted') AS BIGINT) AS unquoted, CAST(0 AS BIGINT)
  AS unknown_path, CAST(count(*) FILTER (outcome = 'bad_value') AS BIGINT) AS bad_value
FROM ver GROUP BY 1""")
def _(v):
    return U.slot_counts(verified(v), ["question_id"])
