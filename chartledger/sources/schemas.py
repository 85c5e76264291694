"""Declared schemas of the record tables. No table is ever read with an inferred schema."""

from chartledger.functions.values import VALUE_TYPE

_BOX = "struct<x:double,y:double,width:double,height:double>"

TABLES = {
    # durable side
    "patient": "patient_id bigint, patient_ref string, abha_ref string, display_name string, "
               "is_synthetic boolean, year_of_birth int, gender string, preferred_language string, "
               "created_at timestamp",
    "patient_identifier": "patient_id bigint, system string, value string, assigner string",
    "encounter": "encounter_id bigint, encounter_ref string, patient_id bigint, "
                 "consent_ref string, session_ref string, occurred_at timestamp, kind string, "
                 "language string, priority string, headline string, confirmed_by string, "
                 "confirmed_at timestamp, summary string, completeness double",
    "clinical_fact": "fact_id bigint, encounter_id bigint, fact_ref string, path string, "
                     f"value {VALUE_TYPE}, display_value string, tier string, state string, "
                     "confidence double, confidence_status string, recorded_at timestamp, "
                     "valid_from timestamp, superseded_by bigint, invalidated_reason string, "
                     "confirmed_by_physician boolean",
    "source_evidence": "evidence_id bigint, fact_id bigint, source_type string, verbatim string, "
                       "language string, modality string, question_id string, turn_id string, "
                       f"asr_confidence double, document_ref string, page int, bbox {_BOX}, "
                       "ocr_confidence double, handwritten boolean, human_reading string, "
                       "read_by string",
    "document": "document_id bigint, encounter_id bigint, document_ref string, filename string, "
                "document_kind string, pages int, ocr_backend string, mean_confidence double, "
                "document_date date, verified_by string, uploaded_at timestamp",
    "extracted_entity": "document_id bigint, kind string, text string, source_text string, "
                        f"page int, bbox {_BOX}, confidence double, handwritten boolean, "
                        "observed_on date, verification string, verified_by string",
    "medication_event": "patient_id bigint, encounter_id bigint, line_no int, name string, "
                        "normalized_name string, dose string, frequency string, duration string, "
                        "route string, status string, observed_on date, document_ref string, "
                        "fact_ref string",
    "observation_event": "seq bigint, patient_id bigint, encounter_id bigint, analyte_key string, "
                         "display string, value double, value_text string, unit string, "
                         "reference_low double, reference_high double, range_flag string, "
                         "range_source string, observed_on date, document_ref string",
    "timeline_event": "patient_id bigint, encounter_id bigint, seq bigint, occurred_on date, "
                      "date_precision string, kind string, label string, detail string, "
                      "document_ref string, fact_ref string, low_confidence boolean",
    "contradiction": "contradiction_ref string, patient_id bigint, encounter_id bigint, "
                     "rule_id string, first_fact string, second_fact string, status string",
    "escalation_event": "encounter_id bigint, rule_id string, fired boolean, level string, "
                        "paths array<string>",
    "decision": "encounter_id bigint, decision string, actor string, decided_at timestamp, "
                "detail string",
    "report_snapshot": "snapshot_id string, encounter_id bigint, audience string, "
                       "report_version string, generated_at timestamp, payload string",
    # terminology
    "code_system": "url string, version string, name string, is_active boolean, "
                   "checksum string, created_on date",
    "concept": "url string, version string, concept_id bigint, code string, display string, "
               "display_normalized string, class_kind string, is_selectable boolean",
    # capture side
    "audit_event": "id bigint, prev_hash string, hash string, ts timestamp, actor string, "
                   "actor_role string, purpose string, consent_ref string, action string, "
                   "payload string, outcome string, model_name string, model_version string, "
                   "prompt_hash string",
    "consent_record": "consent_ref string, session_ref string, granted array<string>, "
                      "refused array<string>, granted_at timestamp, revoked_on timestamp, "
                      "expires_on timestamp",
    "intake_session": "session_ref string, abha_ref string, status string, priority string, "
                      "language string, created_at timestamp, expires_at timestamp, "
                      "purged_at timestamp",
    "session_fact": f"session_id string, seq bigint, fact_id string, path string, "
                    f"value {VALUE_TYPE}, tier string, verbatim string, modality string, "
                    "document_id string, supersede boolean, ts timestamp",
    "session_document": "session_ref string, document_id string, filename string, pages int, "
                        "verified_by string, uploaded_at timestamp",
    "escalation_proposal": "session_id string, rule_id string, fired boolean, level string, "
                           "paths array<string>",
}

#: The columns each table is laid out by: a reader's key first, then one that splits a large key.
LAYOUT = {
    "clinical_fact": ("encounter_id", "fact_id"),
    "source_evidence": ("fact_id", "evidence_id"),
    "medication_event": ("patient_id", "normalized_name"),
    "observation_event": ("patient_id", "seq"),
    "timeline_event": ("patient_id", "seq"),
    "session_fact": ("session_id", "seq"),
    "audit_event": ("id",),
    "encounter": ("patient_id", "encounter_id"),
}
