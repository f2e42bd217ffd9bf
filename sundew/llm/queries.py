"""The registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.llm import alignment, byte_bpe, chat_format, fill_middle, language_id, line_dedup, media_columns, ngram_join, quality_rules, sharding, source_mix, substring_dedup, token_counts
from sundew.plans.tables import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/media/{uuid.uuid4().hex}"
    media_columns.write_texts(documents(spark, sf_dir), path)
    found = media_columns.media_features(media_columns.whole(media_columns.read_media(spark, path)).select("meta", "media", "attempts"))
    meta = F.from_json("meta", "key long, n_bytes long")
    features = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "attempts"]
    return found.withColumn("meta", meta).select(F.col("meta.key").alias("doc_id"), F.col("meta.n_bytes").alias("n_bytes"), *features)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_format.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return views.select("conv_id", "perspective", "piece", "n_turns", "start", "rendered", spans.alias("mask"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, keep=["doc_id"])
    both = byte_bpe.decode(encoded, path, keep=["doc_id", "n_tokens", "ids", "offsets"])
    digest = lambda c: F.sha2(c, 256)
    return both.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"), digest("offsets").alias("offsets_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", source_mix.word_count().alias("size"))
    return source_mix.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir), keep=["doc_id"])
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *base, "kept", "ratio", "reason")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = alignment.ByteRanks(tokenizer_file("byte_bpe_50k.json")), alignment.Pieces(tokenizer_file("piece_bpe_32k.model"))
    return alignment.align(documents(spark, sf_dir).select("doc_id", "text"), a, b, keep=["doc_id"])


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_middle(documents(spark, sf_dir).select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out)
    return language_id.identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_media_columns, op3_chat_format, op4_byte_bpe, op5_substring_dedup, op6_source_mix, op7_sharding, op8_ngram_join, op9_token_counts, op10_quality_rules, op11_alignment, op12_fill_middle, op13_language_id)}

SQL: dict[str, str] = {}

#: Words of a text in DuckDB, for the queries below.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op5_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM starts),
first AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM wins JOIN first USING (win), (SELECT unnest(range(0, 13)) AS k) WHERE low < doc_id),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.at) AS text, count(*) AS n FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL["op8_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reach JOIN links ON d = a)
SELECT doc_id, min(c) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links
FROM documents JOIN reach ON d = doc_id GROUP BY doc_id
"""

SQL["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
lines AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
first AS (SELECT line, length(line) AS n, arg_min(doc_id, (doc_id, pos)) AS d, arg_min(pos, (doc_id, pos)) AS a FROM lines GROUP BY line),
long AS (SELECT * FROM first WHERE n >= 16),
short AS (SELECT line, n, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v FROM (SELECT line, n, unnest(range(1, n + 1)) AS i FROM first WHERE n <= 16)),
met AS (SELECT x.line AS x, y.line AS y FROM long x JOIN long y ON left(x.line, 8) = left(y.line, 8) AND y.n - x.n BETWEEN 0 AND 1 AND x.line <> y.line
        UNION SELECT x.line, y.line FROM long x JOIN long y ON right(x.line, 8) = right(y.line, 8) AND y.n - x.n BETWEEN 0 AND 1 AND x.line <> y.line),
near AS (SELECT x, y FROM met WHERE CASE WHEN length(x) = length(y)
  THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1
  ELSE len(list_filter(range(1, length(y) + 1), lambda i: substr(y, 1, i - 1) || substr(y, i + 1) = x)) > 0 END),
few AS (SELECT a.line AS x, b.line AS y FROM short a JOIN short b ON a.n = b.n AND a.i = b.i AND a.v = b.v AND a.line <> b.line WHERE a.n < 16
        UNION SELECT f.line, b.line FROM short b JOIN first f ON f.line = b.v),
every AS (SELECT x, y FROM near UNION SELECT x, y FROM few),
pairs AS (SELECT x AS line, y AS other FROM every UNION SELECT y, x FROM every),
worse AS (SELECT DISTINCT p.line FROM pairs p JOIN first f ON f.line = p.line JOIN first g ON g.line = p.other WHERE (g.d, g.a) < (f.d, f.a)),
judged AS (SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AS is_line, coalesce((l.doc_id, l.pos) <> (f.d, f.a), false) AS again, w.line IS NOT NULL AS near
  FROM l LEFT JOIN first f ON f.line = l.line AND regexp_matches(l.line, '[^\x20\x09-\x0D]') LEFT JOIN worse w ON w.line = f.line)
SELECT doc_id, count(*) FILTER (is_line) AS n_lines, count(*) FILTER (is_line AND (again OR near)) AS n_removed, count(*) FILTER (is_line AND near AND NOT again) AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_line OR NOT (again OR near)), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op12_fill_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i, 8))::BIGINT) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(text) AS restored_sha256,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256 FROM p
"""

SQL["op3_chat_format"] = r"""
WITH r AS (SELECT conv_id, coalesce(turn, -1) AS turn, role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), text, role) - 1) // 64 AS piece,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), text, role) AS place, role, replace(text, '<|im_', '<\|im_') AS text FROM r),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
v AS (SELECT t.*, perspective, role IS NOT DISTINCT FROM perspective AS mine,
  CASE WHEN role = perspective THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|im_', '<\|im_') END || chr(10) AS head FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
o AS (SELECT *, length(head) + length(text) + 11 AS size, row_number() OVER w AS k, sum(length(head) + length(text) + 11) OVER w AS upto FROM v WINDOW w AS (PARTITION BY conv_id, perspective, piece ORDER BY place ROWS UNBOUNDED PRECEDING)),
p AS (SELECT conv_id, perspective, piece, count(*)::INTEGER AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered, sum(size) AS size,
  coalesce(string_agg((upto - 11 - length(text))::BIGINT::VARCHAR || '-' || (upto - 11)::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (mine), '') AS mask FROM o GROUP BY ALL)
SELECT conv_id, perspective, piece::BIGINT AS piece, n_turns, coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, rendered, mask FROM p
"""
