"""The registered queries of the operators: against their SQL, or column by column against a plain computation."""

import glob
import hashlib
import io
import os
import struct
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from sundew.llm import queries, token_counts
from tests.llm.test_operators import words
from tests.test_queries import SF, rows


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, tables, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(tables.sql(queries.SQL[name]).df())


def test_op2(spark, texts):
    got = queries.QUERIES["op2_media_columns"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    features = {}
    for r in got:
        raw = (texts[r.doc_id].text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", "not compressed"))
            w.writeframes(payload)
        stored = out.getvalue()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.startswith(f"mean={sum(payload) / len(payload):.3f};") and features.setdefault(raw, r.feature) == r.feature


def test_op4(spark, texts):
    import public_tokenizers
    import tiktoken

    from sundew.llm import byte_bpe

    ranks = byte_bpe.load_ranks(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op6(spark, texts):
    got = queries.QUERIES["op6_source_mix"](spark, SF).collect()
    size = {d: len(words(r.text)) for d, r in texts.items()}
    assert sorted((r.doc_id, r.size) for r in got) == sorted(size.items())
    total, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        source = texts[r.doc_id].source
        total[source] += size[r.doc_id]
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
        assert r.taken <= 3 * r.size
    order = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 3 * total[s]}
        if not over:
            break
        full |= over
    for r in got:
        source = texts[r.doc_id].source
        assert r.source_size == total[source] and r.target == pytest.approx(3 * total[source] if source in full else weight[source] * level)
        assert abs(taken[source] - r.target) <= largest[source]


def test_op7(spark, texts):
    got = queries.QUERIES["op7_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op9(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = queries.QUERIES["op9_token_counts"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id].text or ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert token_counts.BLANK == "▁"


def test_op10(spark, texts):
    got = queries.QUERIES["op10_quality_rules"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id].text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert r.base_failed is (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
