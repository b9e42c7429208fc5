"""Registered queries: every operator over its whole table, and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.llm import alignment, brown, chat, licenses, merkle, packing, quality, simhash, substrings, toxicity, trees, warc, wumanber
from quietlog.session import cut, scratch_path

# Most pages are longer, so that their records come in segments.
OP3_SEGMENT_BYTES = 4 << 10
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row. Null texts have no words; rows that repeat are judged alike; rows without doc_id keep all
    words. Empty table: no rows."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts are one token, their end. A row without doc_id is learnt from. Without
    training texts all words are unknown. Empty table: no rows."""
    return brown.score_documents(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page row. Null html is an empty payload; a null page_id is never referred to; rows that repeat the smallest
    page_id of a payload are all responses. A revisit's size is that of its payload. Empty table: no rows."""
    path = scratch_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, segment_bytes=OP3_SEGMENT_BYTES)
    back = cut(
        warc.read_pages(spark, path).select(
            "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
        ),
        "pages",
    )
    responses = back.where("record_type = 'response'")
    sizes = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = back.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left")
    return responses.unionByName(revisits)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts fail the base rules. Strata without enough good labels are not certified
    and only the base rules decide. Empty table: no rows."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "certified", F.array_join("rejected_by", ",").alias("rejected_by"),
    )


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts, and empty benchmarks, have no hits. A null item_id reads "None"."""
    found = wumanber.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("items", ","), 256), F.lit(EMPTY_SHA256)).alias("items_sha256"),
        (F.coalesce(covered, F.lit(0)) > 0).alias("contaminated"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document row; null and empty texts are one piece of one id. Empty table: no rows."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grade per document row; null and empty texts have no features. Without toxic or without clean labels everything is
    grade 0. Empty table: no rows."""
    documents = _table(spark, sf_dir, "documents")
    return toxicity.grade(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree: source / lang / thousand / hundred / name. Every fourth
    document has the name of a licence file; it is one if it holds a notice."""
    documents = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 4 == 0, F.format_string("LICENSE-%d", "doc_id")).otherwise(F.format_string("%d.txt", "doc_id"))
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string"), name)
    return licenses.scan(documents.select("doc_id", path.alias("path"), "text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation, and one for the added conversation -7. Null texts and roles are empty; turns that repeat stay,
    ordered by turn, role and text."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    out = chat.format_chats(table.unionByName(hard))
    turns = chat.parse(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts share the fingerprint 0 and are linked. A null doc_id is never a
    component's id unless all are null. Empty table: no rows."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf per row, also for rows that repeat or have nulls (see `merkle.build`); a row without doc_id is
    never tampered with. Empty table: no rows."""
    documents = _table(spark, sf_dir, "documents")
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    picked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.fold(merkle.build(documents, F.when(picked, merkle.leaf(changed))))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per row, also for rows that repeat; null, empty and unfaithful texts have zeros and an empty digest."""
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per row, also for null and empty texts; a row without doc_id is neither learnt from nor held out.
    Rows that repeat a doc_id are learnt from once. Empty tables: no rows, or scores of 0.5 without labels."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = trees.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_brown": op2_brown,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_contamination": op5_contamination,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_chat_format": op9_chat_format,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_quality_trees": op13_quality_trees,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM texts WHERE len(w) >= 20),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM starts)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS pos FROM again, range(20) AS r(i)),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM texts),
marked AS (SELECT p.*, g.pos IS NOT NULL AS gone FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos),
kept AS (SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)""",
    "op4_quality": r"""
WITH texts AS (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS stratum, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
numbered AS (SELECT *, row_number() OVER () AS row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT row, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM numbered)),
again AS (SELECT row, unnest(range(p, p + 3)) AS p FROM windows QUALIFY count(*) OVER (PARTITION BY row, k) > 1),
repeats AS (SELECT row, count(DISTINCT p) AS n FROM again GROUP BY row),
counts AS (SELECT row, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks FROM numbered LEFT JOIN repeats USING (row)),
bins AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [least(1000, 1000 * n_symbols // greatest(1, word_chars)), least(1000, 1000 * n_dup_lines // greatest(1, n_lines)),
   least(1000, 1000 * n_repeat_words // greatest(1, n_words)), least(1000, 1000 * n_upper // greatest(1, word_chars)),
   least(1000, 1000 * n_marks // greatest(1, n_words)), least(1000, 100 * word_chars // greatest(1, n_words) // 2),
   1000 - least(1000, 100 * word_chars // greatest(1, n_words) // 2)] AS b FROM counts),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) > 0),
held AS (SELECT row, stratum, b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: CAST(ascii(c) AS BIGINT))), lambda r, x: list_reduce(list_prepend(xor(r, x), range(8)),
    lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 3 = 0 AS curve FROM bins JOIN good USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT stratum, count(*) FILTER (WHERE curve) AS n_curve, count(*) FILTER (WHERE NOT curve) AS n_holdout FROM held GROUP BY stratum),
spread AS (SELECT row, stratum, curve, unnest(range(1, 8)) AS rule, unnest(b) AS bin FROM held),
good_bins AS (SELECT stratum, rule, list(bin) AS seen, max(bin) AS last, quantile_disc(bin, 0.5) AS middle FROM spread WHERE curve GROUP BY stratum, rule),
tails AS (SELECT row, min(CASE WHEN bin > last THEN -((bin - last) * 8 // greatest(4, last - middle)) ELSE len(list_filter(seen, lambda x: x >= bin)) END) AS tail
  FROM spread JOIN good_bins USING (stratum, rule) WHERE NOT curve GROUP BY row),
terms AS (SELECT n, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))
  OVER (PARTITION BY n ORDER BY i) AS below FROM (SELECT n, unnest(range(0, n + 1)) AS i FROM (SELECT DISTINCT n_holdout AS n FROM sizes))),
limits AS (SELECT stratum, n_curve, n_holdout, coalesce((SELECT max(i) FROM terms WHERE n = n_holdout AND below <= 0.05 / (SELECT count(*) FROM sizes)), -1) AS allowed FROM sizes),
stops AS (SELECT stratum, min(tail) AS stop FROM (SELECT stratum, tail, row_number() OVER (PARTITION BY stratum ORDER BY tail ROWS UNBOUNDED PRECEDING) AS k,
  count(*) OVER (PARTITION BY stratum ORDER BY tail) AS rejected FROM held JOIN tails USING (row)) JOIN limits USING (stratum) WHERE rejected > allowed GROUP BY stratum),
least_tail AS (SELECT stratum, coalesce(stop, n_curve) AS k FROM limits LEFT JOIN stops USING (stratum) WHERE allowed >= 0 AND n_curve > 0),
ruled AS (SELECT x.row, k, rule, CASE WHEN bin > last THEN -((bin - last) * 8 // greatest(4, last - middle)) ELSE len(list_filter(seen, lambda y: y >= bin)) END AS tail
  FROM (SELECT row, stratum, unnest(range(1, 8)) AS rule, unnest(b) AS bin FROM bins) x JOIN least_tail USING (stratum) JOIN good_bins USING (stratum, rule)),
verdicts AS (SELECT row, coalesce(string_agg(['symbols', 'duplicate_lines', 'repeated_words', 'capitals', 'marks', 'long_words', 'short_words'][rule], ',' ORDER BY rule)
  FILTER (WHERE tail < k), '') AS rejected_by FROM ruled GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, v.row IS NOT NULL AS certified, coalesce(rejected_by, '') AS rejected_by,
  NOT base_failed AND coalesce(rejected_by, '') = '' AS kept FROM bins LEFT JOIN verdicts v USING (row)""",
    "op5_contamination": r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
texts AS (SELECT kind, id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (SELECT id AS item_id, w, least(10, len(w)) AS m FROM texts WHERE kind = 'b' AND len(w) > 0),
patterns AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM items)),
sizes AS (SELECT DISTINCT m FROM patterns),
starts AS (SELECT id AS doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM texts, sizes WHERE kind = 'd' AND len(w) >= m),
hits AS (SELECT doc_id, p, s.m, item_id FROM (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k FROM starts) s
  JOIN patterns USING (m, k)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered ON id = covered.doc_id LEFT JOIN found ON id = found.doc_id WHERE kind = 'd'""",
    "op3_warc": """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
pages_32 AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER)
      >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest FROM hashed),
first AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM pages_32)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to FROM first""",
    "op8_licenses": r"""
WITH templates AS (SELECT * FROM (VALUES TEMPLATE_ROWS) v(template, license, version, text)),
files AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, doc_id // 1000, doc_id // 100) AS directory,
    CASE WHEN doc_id % 4 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name FROM documents),
units AS (
  SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(list_concat(CASE WHEN name LIKE 'LICENSE-%' THEN [text] ELSE [] END,
    [regexp_extract(text, '^(?:[ \t]*(?://|/\*|\*|#|--|;|%|<!--)[^\n]*(?:\n|$))+')], string_split_regex(text, '\n(?:[^A-Za-z0-9\n]*\n)+'),
    string_split_regex(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), '\n'))) AS unit FROM files)),
known AS (SELECT template, license, version, term, count(*) AS tf FROM (
  SELECT *, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN (STOP_WORDS))) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / count(*)) AS idf FROM known GROUP BY term),
shared AS (SELECT DISTINCT unit FROM units WHERE len(list_intersect(regexp_extract_all(lower(unit), '[a-z0-9]+'), (SELECT list(term) FROM idf))) > 0),
unit_terms AS (SELECT unit, term, count(*) AS tf FROM (
  SELECT unit, unnest(list_filter(regexp_extract_all(lower(unit), '[a-z0-9]+'), lambda t: t NOT IN (STOP_WORDS))) AS term FROM shared) GROUP BY unit, term),
uw AS (SELECT unit, term, (1 + ln(tf)) * coalesce(idf, ln(1 + (SELECT count(*) FROM templates))) AS w FROM unit_terms LEFT JOIN idf USING (term)),
tw AS (SELECT template, license, version, term, (1 + ln(tf)) * idf AS w FROM known JOIN idf USING (term)),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY unit),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
cosines AS (SELECT unit, template, license, version, round(sum(uw.w * (tw.w / tn.norm)) / any_value(un.norm), 6) AS cosine
  FROM uw JOIN tw USING (term) JOIN un USING (unit) JOIN tn USING (template) GROUP BY unit, template, license, version HAVING count(*) >= 2),
matched AS (SELECT * FROM cosines WHERE cosine >= 0.6 AND (version IS NULL
    OR list_contains(list_transform(regexp_extract_all(unit, '[0-9]+(?:\.[0-9]+)*'), lambda n: regexp_replace(n, '(?:\.0)+$', '')), version))
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, license) = 1),
own AS (SELECT doc_id, license, cosine FROM units JOIN matched USING (unit)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
licence_files AS (SELECT directory AS holder, license, cosine, directory || '/' || name AS license_path
  FROM own JOIN files USING (doc_id) WHERE name LIKE 'LICENSE-%'
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, directory || '/' || name) = 1),
nearest AS (SELECT directory, l.* FROM (SELECT DISTINCT directory FROM files) f
  JOIN licence_files l ON f.directory = l.holder OR starts_with(f.directory, l.holder || '/')
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(l.holder) DESC) = 1)
SELECT f.doc_id, f.directory || '/' || f.name AS path, coalesce(own.license, a.license) AS license,
  coalesce(own.cosine, a.cosine) AS cosine,
  CASE WHEN own.license IS NOT NULL AND f.name LIKE 'LICENSE-%' THEN 'file' WHEN own.license IS NOT NULL THEN 'notice'
    WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS found_in,
  CASE WHEN own.license IS NOT NULL THEN f.directory || '/' || f.name ELSE a.license_path END AS license_path
FROM files f LEFT JOIN own USING (doc_id) LEFT JOIN nearest a ON f.directory = a.directory""".replace(
        "TEMPLATE_ROWS", ", ".join(
            "({}, '{}', {}, '{}')".format(i, name, f"'{version}'" if version else "NULL", text.replace("'", "''"))
            for i, (name, version, text) in enumerate(licenses.TEMPLATES)
        )
    ).replace("STOP_WORDS", ", ".join(f"'{word}'" for word in licenses.STOP_WORDS)),
    "op9_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
rendered AS (
  SELECT *, '### ' || role || ': ' || CASE WHEN regexp_matches(text, '<\\*/turn>|#\\*## ')
    THEN regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '#(\\*)## ', '#\\\1## ', 'g')
    ELSE text END || '</turn>' || chr(10) AS r FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r)) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id""",
    "op11_merkle": """
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS before,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS after, lang,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(before || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || after) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(before || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || after) END AS changed
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up(lang, lvl, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS many FROM up WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, place, subroot, many FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
climb(doc_id, lang, leaf, start, lvl, pos, n, value, proof) AS (
  SELECT doc_id, lang, leaf, pos, 0, pos, n, coalesce(changed, leaf), '' FROM placed
  UNION ALL
  SELECT doc_id, c.lang, leaf, start, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 0 THEN value || coalesce(s.h, '') ELSE s.h || value END), proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM c.lang AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1),
over(doc_id, leaf, subroot, lvl, pos, n, value, proof) AS (
  SELECT doc_id, leaf, subroot, 0, place, many, value, proof FROM climb c JOIN subroots r ON r.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, o.lvl + 1, o.pos // 2, (o.n + 1) // 2,
    sha256(CASE WHEN o.pos % 2 = 0 THEN value || coalesce(s.h, '') ELSE s.h || value END), proof || coalesce(s.h, '')
  FROM over o LEFT JOIN top s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1) WHERE o.n > 1),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, value AS folded_root, value = root AS verified FROM over, root WHERE n = 1""",
}
