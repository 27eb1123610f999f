"""Queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat_format, decontaminate, fill_middle, html_extract, jaccard_join, licenses, mixing, quality_classifier, quality_rules, shared, spelling, surrogates, token_tables, warc
from quire.sources.tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(_table(spark, sf_dir, "documents"), key="quire-demonstration-key")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(_table(spark, sf_dir, "conversations"))


def op4_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply-ordered conversations without quotes, each as one JSON array of messages (in parts, if it is long)."""
    c = chat_format.chats(chat_format.report(_table(spark, sf_dir, "conversations")))
    return c.select("conv_id", "thread", "part", F.size("messages").alias("n_messages"), F.to_json("messages").alias("messages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_table(spark, sf_dir, "documents"))


def op5_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the stored ledger: no text is read for it."""
    led = shared.written(quality_rules.ledger(_table(spark, sf_dir, "documents"), keep=["doc_id"]), "ledger")
    return quality_rules.ablation(led, quality_rules.BASE).unionByName(quality_rules.ablation(led, quality_rules.PRODUCTION))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(_table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(_table(spark, sf_dir, "documents"))


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(_table(spark, sf_dir, "documents"))


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.report(_table(spark, sf_dir, "documents"), token_tables.public_tokenizer())


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_chat_format": op4_chat_format,
    "op4_chats": op4_chats,
    "op5_quality_rules": op5_quality_rules,
    "op5_quality_ablation": op5_quality_ablation,
    "op6_mixing": op6_mixing,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_jaccard_join": op9_jaccard_join,
    "op9_jaccard_links": op9_jaccard_links,
    "op10_token_tables": op10_token_tables,
    "op11_fill_middle": op11_fill_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_license_scan": op13_license_scan,
}

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_op2 = f"""WITH dw AS (SELECT doc_id, {_ITEM_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM documents),
iw AS (SELECT item_id, {_ITEM_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (SELECT *, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM pos JOIN win USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_five = "('0x' || h[5 * g + 1:5 * g + 5])::BIGINT"
_op3 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(b))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[({_five} // d) % 32 + 1]), '')), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_op5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, s, w[s] AS a, w[s + 1] AS b, w[s + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
 len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
 + CASE WHEN n_words > 0 AND 2 * n_upper > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_marks > n_words THEN 32 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'production-1' AS policy FROM b"""

_policies = ", ".join(f"('{p.version}', '{r.name}', {1 << r.bit}, {p.mask(quality_rules.RULES)})" for p in (quality_rules.BASE, quality_rules.PRODUCTION) for r in quality_rules.RULES if r.name in p.rules)
_op5_ablation = f"""WITH l AS ({_op5}), p(version, rule, bit, mask) AS (VALUES {_policies})
SELECT version, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only, count(*) FILTER (fail_bits & mask IN (0, bit)) AS n_kept_without, count(*) AS n_rows FROM l, p GROUP BY 1, 2"""

_op9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

_draw = "('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {at}, 8))::BIGINT"
_op11 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, {_draw.format(at=1)} AS h1, {_draw.format(at=9)} AS h2, {_draw.format(at=25)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_templates = (*licenses.BASE, *licenses.NOTICES)
_tw = ", ".join(f"({k}, '{t.label}', {t.exact}, {i}, '{w}', {i in licenses.key_places(t)})" for k, t in enumerate(_templates) for i, w in enumerate(t.text.split(" ")))
_op13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM documents),
tw(t, label, exact, q, word, required) AS (VALUES {_tw}),
tok AS (SELECT r, p, word FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) WHERE word IN (SELECT word FROM tw)),
idf AS (SELECT word, round(ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(c, 0))) + 1, 6) AS weight FROM (SELECT DISTINCT word FROM tw) LEFT JOIN (SELECT word, count(DISTINCT r) AS c FROM tok GROUP BY 1) USING (word)),
rare AS (SELECT t, word, weight, row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) AS k FROM (SELECT DISTINCT t, word FROM tw) JOIN idf USING (word)),
idx AS (SELECT tw.*, weight::DECIMAL(18, 6) AS weight, k <= CASE WHEN exact THEN 1 ELSE {licenses.ANCHORS} END AS anchor FROM tw JOIN rare USING (t, word) WHERE required OR k <= {licenses.INDEXED}),
whole AS (SELECT t, sum(required::INTEGER) AS need, least({licenses.AGREE}, sum(anchor::INTEGER)) AS agree, sum(weight) AS total FROM idx GROUP BY 1),
al AS (SELECT r, t, any_value(label) AS label, any_value(exact) AS exact, p - q AS s, sum(required::INTEGER) AS n_required, sum(anchor::INTEGER) AS n_anchors, sum(weight) AS found FROM tok JOIN idx USING (word) GROUP BY r, t, p - q),
hit AS (SELECT r, label, exact, s, least(1.0, round(found::DOUBLE / total::DOUBLE, 6)) AS score FROM al JOIN whole USING (t) WHERE n_required = need AND n_anchors >= agree AND round(found::DOUBLE / total::DOUBLE, 6) >= {licenses.LEAST}),
per AS (SELECT r, count(*) FILTER (exact) AS n_base, min(s) FILTER (exact) AS first_word, max(s) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN per USING (r)"""

ORACLE_SQL: dict[str, str] = {"op2_decontamination": _op2, "op3_warc": _op3, "op5_quality_rules": _op5, "op5_quality_ablation": _op5_ablation, "op9_jaccard_join": _op9, "op11_fill_middle": _op11, "op13_license_scan": _op13}
