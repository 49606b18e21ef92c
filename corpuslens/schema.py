"""Explicit schemas: readers never infer."""

from __future__ import annotations

ARTICLE_RECORD = "url string, title string, seendate string, sourcecountry string, sourcelang string, domain string, `window` string, event_id long, source string, tier long, text_chars long, has_full_text boolean, region string, tickers array<string>, industries array<string>, entity_count long, source_name string, reddit_score long, reddit_comments long, transcript_chars long, duration_minutes double"
CLUSTER_DOCUMENT = "emergent_clusters array<struct<cluster_name:string,description:string,member_indices:array<long>,geographic_pattern:string,maps_to_conventional_category:string>>, singletons array<struct<index:long,why_unique:string>>, meta_observation string"
ANNOTATION = "article_id long, framing_description string, position_types string, register string, embedded_assumptions string, human_agrees_with_llm string, annotator_notes string, language string"
INSTITUTIONAL = "doc_id string, doc_type string, date string, chair struct<position_summary:string,key_framing_language:array<string>>, country_positions array<struct<country:string,position_summary:string,key_framing_language:array<string>,speaker:string>>"
ENTITY = "id long, slug string, name string, entity_type string, document_count long, flight_count long, email_count long, role_description string"
READING = "primary_frame string, positions array<string>, absence_flags array<string>, unspeakable_positions array<string>, confidence_score double, frame_category string"
