"""Default rule tables: escalation, contradiction, question and derivation rules.

Rules are data. An escalation rule is (id, level, label, clauses); it fires when every condition
of any one clause holds. A condition is (path, operator, argument). Identifiers, paths, levels
and arguments are fixed values; the labels are our own words.
"""

IMMEDIATE, URGENT = "immediate", "urgent"

_CARDIO = "review_of_systems.cardiovascular"
_NEURO = "review_of_systems.neurological"
_GI = "review_of_systems.gastrointestinal"
_RESP = "review_of_systems.respiratory"
_GENERAL = "review_of_systems.general"
_GU = "review_of_systems.genitourinary"
_PREGNANT = ("personal_history.pregnancy", "in", ["yes", "maybe"])


def _has(path, *values):
    return (path, "in", list(values))


def _is(path, value):
    return (path, "eq", value)


# Escalation rules.
ESCALATION_RULES = [
    ("RF-CARD-01", IMMEDIATE, "Chest pain with warning features", [
        [_is("hpi.site", "chest"),
         _has("hpi.associated", "sweating", "breathlessness", "palpitations")],
        [_is("hpi.site", "chest"), _has("hpi.radiation", "left_arm", "jaw_neck")],
        [_is("hpi.site", "chest"), _is("hpi.onset", "sudden"), ("hpi.severity", "gte", 7)],
    ]),
    ("RF-CARD-02", URGENT, "Chest pain brought on by effort", [
        [_has(_CARDIO, "chest_pain_exertion")],
        [_is("hpi.site", "chest"), _has("hpi.exacerbating", "worse_effort")],
    ]),
    ("RF-CARD-03", URGENT, "Cannot lie flat, ankles swollen", [
        [_has(_CARDIO, "orthopnoea"), _has(_CARDIO, "ankle_swelling")],
    ]),
    ("RF-NEURO-01", IMMEDIATE, "Sudden loss of function on examination by history", [
        [_has(_NEURO, "limb_weakness")],
        [_has(_NEURO, "facial_droop")],
        [_has(_NEURO, "speech")],
        [_has(_NEURO, "vision_loss")],
        [_has("hpi.associated", "weakness_limb")],
        [_has("hpi.associated", "speech_trouble")],
    ]),
    ("RF-NEURO-02", IMMEDIATE, "Sudden worst headache", [
        [_has(_NEURO, "thunderclap")],
        [_is("hpi.site", "head"), _is("hpi.onset", "sudden"), ("hpi.severity", "gte", 8)],
    ]),
    ("RF-NEURO-03", IMMEDIATE, "Stiff neck and fever", [[_has(_NEURO, "neck_stiff")]]),
    ("RF-NEURO-04", URGENT, "Seizure", [[_has(_NEURO, "fits")]]),
    ("RF-BLEED-01", IMMEDIATE, "Blood vomited or black stool", [
        [_has(_GI, "haematemesis")],
        [_has(_GI, "melaena")],
    ]),
    ("RF-BLEED-02", URGENT, "Blood coughed up", [[_has(_RESP, "haemoptysis")]]),
    ("RF-BLEED-03", URGENT, "Bleeding mentioned with the complaint", [
        [_has("hpi.associated", "bleeding")],
        [_has(_GENERAL, "bleeding_any")],
        [_has(_GU, "haematuria")],
    ]),
    ("RF-RESP-01", IMMEDIATE, "Short of breath now", [[_has("hpi.associated", "breathlessness")]]),
    ("RF-RESP-02", URGENT, "Long cough with general symptoms", [
        [_has(_RESP, "cough_3wk"), _has(_RESP, "night_sweats")],
        [_has(_RESP, "cough_3wk"), _has(_GENERAL, "weight_loss")],
        [_has(_RESP, "cough_3wk"), _has(_GENERAL, "fever_persistent")],
    ]),
    ("RF-ABDO-01", IMMEDIATE, "Sudden severe belly pain", [
        [_is("hpi.site", "abdomen"), _is("hpi.onset", "sudden"), ("hpi.severity", "gte", 7)],
    ]),
    ("RF-ABDO-02", URGENT, "Belly pain through to the back", [
        [_is("hpi.site", "abdomen"), _has("hpi.radiation", "back")],
    ]),
    ("RF-ABDO-03", URGENT, "Yellow eyes or skin", [[_has(_GI, "jaundice")]]),
    ("RF-SYS-01", URGENT, "Weight lost without trying", [
        [_has("hpi.associated", "weight_loss")],
        [_has(_GENERAL, "weight_loss")],
        [_has(_GI, "weight_loss")],
    ]),
    ("RF-SYS-02", IMMEDIATE, "Severe allergic reaction before", [
        [_is("drug_allergy.allergy_reaction", "swelling")],
        [_is("drug_allergy.allergy_reaction", "breathing")],
        [_is("drug_allergy.allergy_reaction", "collapse")],
    ]),
    ("RF-SYS-03", URGENT, "Fainted or collapsed", [
        [_has(_NEURO, "fainting")],
        [_has("hpi.associated", "dizziness")],
    ]),
    ("RF-SYS-04", URGENT, "Trouble swallowing", [[_has(_GI, "swallowing")]]),
    ("RF-SYS-05", IMMEDIATE, "Cannot pass urine", [[_has(_GU, "retention")]]),
    ("RF-OBS-01", IMMEDIATE, "May be pregnant, with belly pain or bleeding", [
        [_PREGNANT, _is("hpi.site", "abdomen")],
        [_PREGNANT, _has("hpi.associated", "bleeding")],
    ]),
    ("RF-PAIN-01", URGENT, "Pain nine or ten", [[("hpi.severity", "gte", 9)]]),
]

# Denials. (id, denying path, test, argument, contradicting group, field, or path).
DENIAL_RULES = [
    ("CX-MED-01", "drug_allergy.taking_medicines", "equals", False, "medications", "name", None),
    ("CX-MED-02", "drug_allergy.taking_medicines", "equals", False, None, None,
     "drug_allergy.medicines"),
    ("CX-ALG-01", "drug_allergy.has_allergy", "equals", False, "allergies", "substance", None),
    ("CX-PMH-01", "past_medical.conditions", "contains_value", "none", "problems",
     "reported_term", None),
    ("CX-SURG-01", "past_surgical.any", "equals", False, "procedures", "name", None),
]
CROSS_TIER_PATHS = (
    "chief_complaint.duration",
    "hpi.severity",
    "personal_history.tobacco",
    "personal_history.alcohol",
)

# Derived questions. path -> (input path, bands of (bounds, value)).
DERIVATIONS = {
    "ayush.vaya": ("demographics.age_years", [
        ({"lt": 16}, "balya"),
        ({"lt": 60}, "madhya"),
        ({"gte": 60}, "vriddha"),
    ]),
}

_NOT_SPECIFIC = ["fever", "cough", "weakness", "skin", "checkup"]
_PAINLIKE = ("any", [
    ("chief_complaint.text", "not_recorded", True),
    ("chief_complaint.text", "not_in", _NOT_SPECIFIC),
])

# Questions. (id, section, path, kind, options, critical, all-conditions).
# An option is (value, exclusive). Labels follow from the values by rule.
QUESTIONS = [
    ("cc.text", "chief_complaint", "chief_complaint.text", "open_text",
     [("pain", False), ("fever", False), ("cough", False), ("stomach", False),
      ("weakness", False), ("injury", False), ("skin", False), ("checkup", False),
      ("other", False)], False, []),
    ("cc.duration", "chief_complaint", "chief_complaint.duration", "duration",
     [("today", False), ("days_1_3", False), ("week_1", False), ("weeks_2_4", False),
      ("months_1_6", False), ("months_6_plus", False)], False, []),
    ("hpi.site", "hpi", "hpi.site", "single_choice",
     [("head", False), ("chest", False), ("abdomen", False), ("back", False), ("limbs", False),
      ("joints", False), ("throat", False), ("whole_body", False), ("other", False)], False, []),
    ("hpi.onset", "hpi", "hpi.onset", "single_choice",
     [("sudden", False), ("gradual", False), ("after_event", False), ("unsure", False)], True, []),
    ("hpi.character", "hpi", "hpi.character", "single_choice",
     [("sharp", False), ("dull", False), ("burning", False), ("cramping", False),
      ("pressure", False), ("throbbing", False), ("tingling", False)], False,
     [("hpi.site", "recorded", True), _PAINLIKE]),
    ("hpi.radiation", "hpi", "hpi.radiation", "single_choice",
     [("none", False), ("left_arm", False), ("jaw_neck", False), ("back", False),
      ("leg", False), ("groin", False), ("other", False)], True,
     [("hpi.site", "in", ["chest", "abdomen", "back", "head"]), _PAINLIKE]),
    ("hpi.associated", "hpi", "hpi.associated", "multi_choice",
     [("none", True), ("fever", False), ("vomiting", False), ("breathlessness", False),
      ("sweating", False), ("dizziness", False), ("palpitations", False),
      ("weight_loss", False), ("bleeding", False), ("weakness_limb", False),
      ("speech_trouble", False), ("vision_change", False)], True, []),
    ("hpi.timing", "hpi", "hpi.timing", "single_choice",
     [("constant", False), ("intermittent", False), ("worsening", False), ("improving", False),
      ("night_worse", False)], False, []),
    ("hpi.exacerbating", "hpi", "hpi.exacerbating", "multi_choice",
     [("worse_movement", False), ("worse_effort", False), ("worse_food", False),
      ("worse_empty", False), ("worse_lying", False), ("better_rest", False),
      ("better_medicine", False), ("nothing_helps", False)], False, []),
    ("hpi.severity", "hpi", "hpi.severity", "scale", [], False, []),
    ("pmh.conditions", "past_medical", "past_medical.conditions", "multi_choice",
     [("none", True), ("diabetes", False), ("hypertension", False), ("heart", False),
      ("asthma", False), ("tb", False), ("thyroid", False), ("kidney", False),
      ("stroke", False), ("arthritis", False), ("anaemia", False), ("ulcer", False),
      ("unsure", False)], False, []),
    ("pmh.hospitalised", "past_medical", "past_medical.hospitalised", "boolean", [], False, []),
    ("pmh.hospital_reason", "past_medical", "past_medical.hospital_reason", "open_text", [],
     False, [("past_medical.hospitalised", "eq", True)]),
    ("psh.any", "past_surgical", "past_surgical.any", "boolean", [], False, []),
    ("psh.which", "past_surgical", "past_surgical.which", "multi_choice",
     [("appendix", False), ("gallbladder", False), ("caesarean", False),
      ("hysterectomy", False), ("hernia", False), ("cataract", False), ("bone", False),
      ("heart_surgery", False), ("other", False)],
     False, [("past_surgical.any", "eq", True)]),
    ("psh.year", "past_surgical", "past_surgical.year", "open_text", [], False,
     [("past_surgical.any", "eq", True)]),
    ("med.taking", "drug_allergy", "drug_allergy.taking_medicines", "boolean", [], True, []),
    ("med.list", "drug_allergy", "drug_allergy.medicines", "open_text", [], True,
     [("drug_allergy.taking_medicines", "eq", True)]),
    ("med.ayush_taking", "drug_allergy", "drug_allergy.ayush_medicines", "boolean", [], True, []),
    ("allergy.any", "drug_allergy", "drug_allergy.has_allergy", "boolean", [], True, []),
    ("allergy.what", "drug_allergy", "drug_allergy.allergy_substance", "open_text", [], True,
     [("drug_allergy.has_allergy", "eq", True)]),
    ("allergy.reaction", "drug_allergy", "drug_allergy.allergy_reaction", "single_choice",
     [("rash", False), ("swelling", False), ("breathing", False), ("collapse", False),
      ("stomach", False)], True,
     [("drug_allergy.has_allergy", "eq", True)]),
    ("fh.conditions", "family_history", "family_history.conditions", "multi_choice",
     [("none", True), ("diabetes", False), ("hypertension", False), ("heart", False),
      ("stroke", False), ("cancer", False), ("tb", False), ("asthma", False), ("mental", False),
      ("unsure", False)], False, []),
    ("ph.tobacco", "personal_history", "personal_history.tobacco", "single_choice",
     [("never", False), ("current_smoke", False), ("current_chew", False),
      ("current_both", False), ("former", False)], False, []),
    ("ph.alcohol", "personal_history", "personal_history.alcohol", "single_choice",
     [("never", False), ("occasional", False), ("weekly", False), ("daily", False),
      ("former", False)], False, []),
    ("ph.diet", "personal_history", "personal_history.diet", "single_choice",
     [("veg", False), ("nonveg", False), ("mixed", False), ("vegan", False)], False, []),
    ("ph.sleep", "personal_history", "personal_history.sleep", "single_choice",
     [("good", False), ("disturbed", False), ("difficulty", False), ("insufficient", False)], False, []),
    ("ph.bowel", "personal_history", "personal_history.bowel", "single_choice",
     [("regular", False), ("constipated", False), ("loose", False), ("alternating", False)], False, []),
    ("ph.occupation", "personal_history", "personal_history.occupation", "single_choice",
     [("farming", False), ("labour", False), ("shop", False), ("office", False),
      ("home", False), ("retired", False), ("none", False)], False, []),
    ("ph.pregnancy", "personal_history", "personal_history.pregnancy", "single_choice",
     [("no", False), ("yes", False), ("maybe", False), ("na", False)], False,
     [("demographics.gender", "eq", "female"), ("demographics.age_years", "gte", 12),
      ("demographics.age_years", "lte", 55)]),
    ("ros.cardio", "review_of_systems", _CARDIO, "multi_choice",
     [("none", True), ("chest_pain", False), ("chest_pain_exertion", False),
      ("palpitations", False), ("ankle_swelling", False), ("orthopnoea", False)], False, []),
    ("ros.resp", "review_of_systems", _RESP, "multi_choice",
     [("none", True), ("cough", False), ("cough_3wk", False), ("haemoptysis", False),
      ("breathlessness", False), ("wheeze", False), ("night_sweats", False)], False, []),
    ("ros.gi", "review_of_systems", _GI, "multi_choice",
     [("none", True), ("nausea", False), ("vomiting", False), ("haematemesis", False),
      ("melaena", False), ("blood_stool", False), ("appetite_loss", False),
      ("weight_loss", False), ("swallowing", False), ("jaundice", False)], False, []),
    ("ros.neuro", "review_of_systems", _NEURO, "multi_choice",
     [("none", True), ("headache", False), ("thunderclap", False), ("fits", False),
      ("fainting", False), ("limb_weakness", False), ("facial_droop", False), ("speech", False),
      ("vision_loss", False), ("numbness", False), ("neck_stiff", False)], False, []),
    ("ros.gu", "review_of_systems", _GU, "multi_choice",
     [("none", True), ("burning", False), ("frequency", False), ("nocturia", False),
      ("haematuria", False), ("retention", False), ("incontinence", False)], False, []),
    ("ros.msk", "review_of_systems", "review_of_systems.musculoskeletal", "multi_choice",
     [("none", True), ("joint_pain", False), ("joint_swelling", False),
      ("morning_stiffness", False), ("back_pain", False), ("walking_difficulty", False)], False, []),
    ("ros.general", "review_of_systems", _GENERAL, "multi_choice",
     [("none", True), ("fever", False), ("fever_persistent", False), ("fatigue", False),
      ("weight_loss", False), ("night_sweats", False), ("lumps", False), ("rash", False),
      ("bleeding_any", False)],
     False, []),
]

# The term looked up for a chosen condition.
CONDITION_TERMS = {
    "diabetes": "Type 2 diabetes mellitus",
    "hypertension": "Essential hypertension",
    "heart": "Angina pectoris",
    "asthma": "Asthma",
    "tb": "Tuberculosis of the respiratory system",
    "thyroid": "Hypothyroidism",
    "kidney": "Chronic kidney disease",
    "stroke": "Cerebrovascular accident, unspecified",
    "arthritis": "Osteoarthritis of knee",
    "anaemia": "Anaemia due to iron deficiency",
    "ulcer": "Peptic ulcer",
}

# The severity scale.
SCALE_MIN, SCALE_MAX = 0, 10
SCALE_ANCHORS = (
    "No trouble at all", "Mild", "Uncomfortable", "Bad", "Very bad", "Worst I can imagine",
)


def option_values(question):
    """Option values of one QUESTIONS row."""
    return [value for value, _exclusive in question[4]]


def exclusive_values(question):
    return [value for value, exclusive in question[4] if exclusive]


def label_of(value):
    """The wording shown for an option value: underscores read as spaces, first letter capital."""
    words = value.replace("_", " ")
    return words[:1].upper() + words[1:]


def question_paths():
    return [q[2] for q in QUESTIONS] + list(DERIVATIONS)
