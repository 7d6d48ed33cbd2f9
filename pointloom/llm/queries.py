"""The training-data operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language_model, line_dedup, packing, pieces, pii, quality, simhash, structure, url_filter, warc

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
#: Documents with this remainder are held out from language-model training.
FOLDS, HELD_OUT = 7, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def held_out(doc_id="doc_id"):
    """Whether a document is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = language_model.score(docs, docs.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def _count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.search(table(spark, sf_dir, "documents"), with_text=False)
    counts = [_count_of(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.code(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, and in ``n`` how often each is left."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(text("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("n"),
    )


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair(damaged(table(spark, sf_dir, "conversations")), "n", with_text=False).drop("repaired")


QUERIES = {f.__name__: f for f in (op1_warc, op2_url_filter, op3_line_dedup, op4_language_model, op5_simhash, op6_packing, op7_chat, op8_quality, op9_decontaminate, op10_pii, op11_sentencepiece, op12_structure)}


#: Blanks as a RE2 class.
GAP = r"[\x20\x09-\x0D]"

ORACLE = {
    # Base 32 in SQL: 5 bits at a time from the digest's 40 hex digits, 10 digits (two 20-bit halves) at once.
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, h,
                     array_to_string(list_transform(range(0, 32), lambda i:
                         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
              FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
        FROM w""",
    "op2_url_filter": r"""
        WITH u AS (SELECT page_id,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
                   FROM pages),
        r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT u.page_id, u.host, u.path, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS verdict
              FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
              GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m""",
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, k.i, k.line, c.owner IS NOT NULL AND c.owner <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op9_decontaminate": r"""
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        bx AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win FROM bw WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM bx),
        dx AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM dw, sizes WHERE len(w) >= n),
        hit AS (SELECT dx.doc_id, dx.i, dx.n, bx.item_id FROM dx JOIN bx ON dx.win = bx.win AND dx.n = bx.n),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
               sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id""",
    # The automaton's four states side by side, each with its cheapest (cost, audit, lines) so far; CRC-32 bit by bit.
    "op12_structure": r"""
        WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
        crc AS (SELECT *, xor(4294967295, list_reduce(flatten([[4294967295]] || list_transform(range(1, length(k) + 1), lambda i: [CAST(ord(k[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 20 AS harm FROM src),
        hurt AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                        unnest(CASE harm WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc),
        seen AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER o AS i, lag(role[1]) OVER o AS before,
                        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
                 FROM hurt WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
        fault AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN body[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 4 END AS kind FROM seen),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 3) AS truncated,
                          count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n,
                          list({'r': role, 'x': text, 'q': role[1], 'must': kind < 3, 'cut': CASE WHEN kind = 3 THEN 3 ELSE 0 END} ORDER BY i) AS turns
                   FROM fault GROUP BY conv_id),
        walk AS (
            SELECT conv_id, turns, n, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 't': ''} AS s0, {'c': 1000000000, 'a': '', 't': ''} AS s1, {'c': 3, 'a': 'I', 't': chr(10) || 'user:'} AS s2, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3 FROM counts
            UNION ALL
            SELECT conv_id, turns, n, i, s0, s1, e2, list_min([b3, {'c': e2.c + 3, 'a': e2.a || 'I', 't': e2.t || chr(10) || 'assistant:'}]) AS s3
            FROM (SELECT *, list_min([b2] || list_transform([s0, s1, b3], lambda s: {'c': s.c + 3, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'})) AS e2
                  FROM (SELECT conv_id, turns, n, i + 1 AS i, {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} AS s0,
                               list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, {'c': CASE WHEN NOT x.must AND x.q = 's' THEN s0.c + x.cut ELSE 1000000000 END, 'a': s0.a || 'K', 't': s0.t || keep}]) AS s1,
                               list_min([{'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}] || flatten(list_transform([s0, s1, s3], lambda s: [
                                   {'c': CASE WHEN NOT x.must AND x.q = 'u' THEN s.c + x.cut ELSE 1000000000 END, 'a': s.a || 'K', 't': s.t || keep},
                                   {'c': CASE WHEN NOT x.must THEN s.c + 3 + x.cut ELSE 1000000000 END, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || x.x}]))) AS b2,
                               list_min([{'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t},
                                   {'c': CASE WHEN NOT x.must AND x.q = 'a' THEN s2.c + x.cut ELSE 1000000000 END, 'a': s2.a || 'K', 't': s2.t || keep},
                                   {'c': CASE WHEN NOT x.must THEN s2.c + 3 + x.cut ELSE 1000000000 END, 'a': s2.a || 'R', 't': s2.t || chr(10) || 'assistant:' || x.x}]) AS b3
                        FROM (SELECT *, turns[i + 1] AS x, chr(10) || turns[i + 1].r || ':' || turns[i + 1].x AS keep FROM walk WHERE i < n)))),
        best AS (SELECT conv_id, list_min([s0, s3]) AS s FROM walk WHERE i = n)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(s.t[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
