"""Explicit schemas; nothing is inferred."""

SENTENCE = "tokens array<string>, labels array<string>"
PREPARED = "sentence string, labels string"
SPLIT_CORPUS = f"lang string, split string, {SENTENCE}"
ARTICLE = (
    "uuid string, created string, published string, language string, url string, "
    "media struct<uuid:string, name:string, tags:array<struct<class:string, name:string>>>, country struct<name:string>, "
    "rubric struct<uuid:string, name:string>, tags array<struct<uuid:string, class:string>>, "
    "translations map<string, struct<title:string, body:string>>"
)
SCORES = "sample_id bigint, label_idx int, y_true double, y_prob double"
TOPICS = "qid string, query string"
QRELS = "qid string, q0 string, docid string, rel int"
PASSAGES = "docid string, title string, text string"
