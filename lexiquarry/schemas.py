"""Table schemas. All fields but a document's id may be missing."""

# What a document keeps of what its source says about it.
KEPT = [
    "document_number", "title", "type", "subtype", "abstract", "action",
    "publication_date", "effective_on", "comments_close_on", "signing_date",
    "citation", "volume", "start_page", "end_page", "page_length",
    "docket_ids", "regulation_id_numbers", "topics", "significant",
    "html_url", "regulations_dot_gov_url", "correction_of",
    "executive_order_number", "presidential_document_number",
]
#: Kinds of the fields that are not strings.
KINDS = {"volume": "bigint", "start_page": "bigint", "end_page": "bigint", "page_length": "bigint", "docket_ids": "array<string>", "regulation_id_numbers": "array<string>", "topics": "array<string>", "significant": "boolean"}
_BASE = [f"{name} {KINDS.get(name, 'string')}" for name in KEPT]

DOCUMENT = ", ".join([*_BASE, "agency_names array<string>", "cfr_references array<string>", "text string", "char_count bigint", "word_count bigint"])
DETAIL = ", ".join([*_BASE, "agencies array<struct<name:string,raw_name:string>>", "cfr_references array<struct<title:bigint,part:bigint>>", "raw_text_url string"])
CHUNK = "chunk_id string, doc_id string, title string, agency string, text string, position int"
QUESTION = "id string, type string, question string, answer string, answer_field string, gold_doc string, distractors array<string>, corpus_occurrences bigint, note string, removed_terms array<string>, title_words_reused array<string>"
RESULT = (
    "id string, type string, question string, gold_doc string, retrieved array<string>, corpus_occurrences bigint, expected string, answer_in_context boolean, "
    "answer_in_gold_context boolean, hit boolean, rank int, confused_with string, generated string, refused boolean, answer_correct boolean, generation_error string"
)
VERDICT = "answer_key string, verdict string, id string, question string, expected string, generated string"
