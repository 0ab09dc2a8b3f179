"""Table schemas. Nothing is inferred: every reader gets one of these."""

from __future__ import annotations

from pyspark.sql.types import StructType

ITEM = "struct<no: string, text: string>"
SUB_CLAUSE = f"struct<no: string, text: string, items: array<{ITEM}>>"
CLAUSE = f"struct<no: string, text: string, sub_clauses: array<{SUB_CLAUSE}>>"
TREE = f"struct<clauses: array<{CLAUSE}>>"
THRESHOLD = "struct<kind: string, op: string, value: double, unit: string>"
DIFF = "struct<added: map<string, string>, removed: map<string, string>, changed: map<string, struct<from: string, to: string>>>"

STATUTE = "statute_id long, name string, law_type string, ministry_code string, current_mst string, parent_id long, abbreviations array<string>, enforced_on date"
ARTICLE = "article_id long, statute_id long, art_no int, branch_no int, chapter_title string"
ARTICLE_VERSION = (
    f"article_key long, article_id long, moleg_article_key string, title string, body string, tree {TREE}, valid_from date, valid_to date, "
    "promulgated_on date, promulgation_no int, revision_type string, is_full_rewrite boolean, revision_reason string, ingested_at timestamp"
)
ARTICLE_DIFF = f"from_version long, to_version long, diff {DIFF}, added_thresholds array<{THRESHOLD}>, reason_source string"
REWRITE_MAP = "from_article_id long, to_article_id long, note string"
ADDENDUM = "addendum_id long, statute_id long, promulgation_no int, clause_no string, kind string, applies_from date, body string, target_articles array<long>"
RULING = (
    "ruling_id string, source string, case_no string, decided_on date, outcome string, gist string, body string, body_available boolean, "
    "anti_avoidance array<string>, cited_articles array<string>, cited_article_ids array<long>, raw_uri string"
)
PATTERN_TYPE = "code string, name string, description string"
LOOPHOLE = (
    "id long, article_id long, origin_ruling string, status string, patched_by long, patched_on date, pattern_type string, "
    "claim_deadline date, risk_score decimal(4,3), confirmed_by string, note string"
)
EMBEDDING = "chunk_id long, article_key long, chunk_path string, text string, embedding array<float>, is_current boolean"

TABLES: dict[str, str] = {
    "statute": STATUTE, "article": ARTICLE, "article_version": ARTICLE_VERSION, "article_diff": ARTICLE_DIFF, "article_rewrite_map": REWRITE_MAP,
    "addendum": ADDENDUM, "ruling": RULING, "pattern_type": PATTERN_TYPE, "loophole_candidate": LOOPHOLE, "article_embedding": EMBEDDING,
}


def struct(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
