"""Schemas of the data model."""

MENTION = "mention_id string, doi string, raw_name string, lastname string, firstname string, orcid string, affiliation string, venue string, year string, coauthors array<string>, _original_index bigint"
AUTHOR_DUMP = "original_name string, lastname string, firstname string, orcid string, doi string, journal string, affiliation string, year string, coauthors array<string>"
RECORD = "record_id string, name string, coauthors array<string>, journal string, publication_title string, year int, affiliation string, processed boolean, matched_author_id string, source string, imported_at timestamp"
AUTHOR = "author_id string, canonical_name string, orcid string, coauthors array<string>, journals array<string>, affiliations array<string>, alternate_names array<string>, linked_records array<string>, confidence_score double, seq bigint"
ARTICLE = "DOI string, `container-title` array<string>, published struct<`date-parts`:array<array<int>>>, title array<string>, author array<struct<given:string,family:string,ORCID:string,sequence:string,affiliation:array<struct<name:string>>>>"
CLUSTER = "cluster_id string, mention_id string"
DECISION = "mention_id string, decision string, score_total double, best_author_id string, candidate_count bigint, reason string"
EDGE = "src string, dst string, weight bigint"
RUN = "run_id string, timestamp string, experiment string, config_hash string, dataset string, metrics map<string,double>, output string"
