"""One registered query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsonde.llm import bagminhash, knn, langid, licences, linededup, llr, merkle, packing, pieces, pii, tiling, trie, warc
from gridsonde.llm.shared import id_remainder, table
from gridsonde.session import scratch_path

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PATH = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status of every page, from archives written and read."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = warc.read_whole(spark, path)
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                        F.col("type").alias("record_type"), warc.page_of("refers_to").alias("refers_to"), "status")


ORACLES["op1_warc"] = r"""
WITH bits AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     coded AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(hex, 1 + (g // 8) * 10, 10) AS BIGINT) >> (35 - 5 * (g % 8))) & 31 AS INTEGER), 1), '' ORDER BY g)
                   FROM range(32) AS t(g)) AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to, 'ok' AS status
FROM coded WINDOW same AS (PARTITION BY hex, payload_bytes)"""


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every document."""
    return pieces.encoded_documents(table(spark, sf_dir, "documents"), MODEL_PATH)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; four fifths of the ids teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(True)))
    profiles = langid.learn(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


@query
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest of every document that a benchmark item contaminates."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document; lines of ten documents or more go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = linededup.LineIndex.empty(spark).insert(docs)
    return index.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     parts AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM rows_),
     keyed AS (SELECT r, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts),
     common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
     kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
                     coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (key NOT IN (SELECT key FROM common)), '') AS text
              FROM keyed GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept JOIN rows_ USING (r)"""


def quality_model(docs: DataFrame, labels: DataFrame) -> knn.Neighbours:
    """Learned from labelled documents outside the held-out third."""
    taught = labels.where(id_remainder("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    return knn.fit(docs, taught)


@query
def op8_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    docs = docs.withColumn("held_out", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(True)))
    return knn.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id of every document."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op6_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base counts, base_failed, kept and score of every document; trusted are those labelled good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = llr.filtered(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.spans(docs, pii.fit(docs)).drop("text")


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, families, n_licence, n_unknown, licence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scanned(docs, licences.fit(docs)).drop("text")


# crc32 of a decimal number, in a table (c, crc) over the numbers c of a table ``numbers``.
_CRC = """
bytes_ AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crcs AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
                lambda a, b: xor(a >> 8, t[(1 + (xor(a, b) & 255))::INT])), 4294967295) AS crc FROM numbers, bytes_)"""


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 6) -> str:
    """Levels one by one; 16 to the power ``levels`` rows a source pos most. ``lN`` and ``gN`` are the nodes N levels above leaves and subroots."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    low = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    parts = [f"""numbers AS (SELECT DISTINCT doc_id AS c FROM documents WHERE doc_id IS NOT NULL)""", _CRC,
             f"""docs AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed
                 FROM documents LEFT JOIN crcs ON c = doc_id)""",
             """placed AS (SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM docs)""",
             "l0 AS (SELECT tree, pos, leaf AS node FROM placed)"]

    def climb(p: str) -> None:
        for k in range(levels):
            parts.append(f"""{p}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node
                             FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {p}{k}) GROUP BY tree, pos // 16)""")
            parts.append(f"""{p}s{k} AS (SELECT tree, pos, coalesce(string_agg(node, '' ORDER BY pos) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                             coalesce(string_agg(node, '' ORDER BY pos) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt,
                             count(*) OVER (PARTITION BY tree) > 1 AS deeper FROM {p}{k} WINDOW run AS (PARTITION BY tree, pos // 16 ORDER BY pos))""")

    climb("l")
    parts.append(f"""g0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, node, tree AS name FROM l{levels})""")
    climb("g")
    joins, steps = [], []
    for p, place, tree in (("l", "placed.pos", "placed.tree"), ("g", "g0.pos", "''")):
        for k in range(levels):
            joins.append(f"JOIN {p}s{k} ON {p}s{k}.tree = {tree} AND {p}s{k}.pos = {place} // {16 ** k}")
            steps.append(f"{p}s{k}")
    proof = " || ".join(f"{s}.lft || {s}.rgt" for s in steps)
    parts.append(f"""f0 AS (SELECT doc_id, leaf, g0.node AS subroot, g{levels}.node AS root, sha256({proof}) AS proof_sha256, changed AS folded,
                     {', '.join(f'{s}.lft AS {s}_l, {s}.rgt AS {s}_r, {s}.deeper AS {s}_d' for s in steps)}
                     FROM placed JOIN g0 ON g0.name = placed.tree CROSS JOIN g{levels} {' '.join(joins)})""")
    for k, s in enumerate(steps):
        parts.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {s}_d THEN sha256({s}_l || folded || {s}_r) ELSE folded END AS folded) FROM f{k})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM f{len(steps)}"


ORACLES["op11_merkle"] = _merkle_sql()


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_PATH)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return trie.nodes(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = f"""
WITH numbers AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), {_CRC},
own AS (SELECT conv_id AS c, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
               octet_length(encode(coalesce(text, ''))) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS pos FROM own),
turns AS (SELECT crcs.c, pos, key, size FROM crcs JOIN placed ON placed.c = crcs.c AND pos > crc % 9
          UNION ALL SELECT crcs.c, pos, key, size FROM crcs JOIN placed ON placed.c = crcs.c - crcs.c % 5 AND pos <= crc % 9),
steps AS (SELECT c, size, row_number() OVER w AS depth, md5(string_agg(key, '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node FROM turns WINDOW w AS (PARTITION BY c ORDER BY pos)),
members AS (SELECT c, 0 AS size, 0 AS depth, '' AS node FROM numbers UNION ALL SELECT * FROM steps),
ending AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent FROM members),
trie AS (SELECT node, max(parent) AS parent, max(depth) AS depth, max(size) AS size, min(c) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM ending GROUP BY node),
below AS (SELECT m.node, count(*) FILTER (x.leaf) AS n_leaves, CAST(sum((x.n_convs - 1) * x.size) AS BIGINT) AS saved_tokens
          FROM trie x JOIN members m ON m.c = x.conv_id AND m.depth <= x.depth GROUP BY m.node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM trie WHERE depth > 0 GROUP BY parent)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, t.ends_sha256
FROM trie t JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN trie p ON p.node = t.parent AND t.depth > 0"""
