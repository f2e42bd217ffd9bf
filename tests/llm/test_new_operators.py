"""Alignment, fill-in-middle and language identification against brute force, and the registered queries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sundew.llm import alignment, fill_middle, language_id, queries
from sundew.llm.queries import tokenizer_file
from tests.test_queries import SF


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def plain_alignment(texts, libraries):
    """Both libraries over whole texts, ends met one by one, links as counters."""
    a, b = libraries
    letters = alignment.byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelled = [[spell(i) for i in x] for spell, x in zip((spell_a, spell_b), ids)]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            found.append(None)
            continue
        ends = [[sum(map(len, s[: i + 1])) for i in range(len(s))] if len(s) < 300 else list(_running(s)) for s in spelled]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for end in shared:
            group = []
            for k in (0, 1):
                stop = ends[k].index(end, at[k]) + 1
                group.append(ids[k][at[k] : stop])
                at[k] = stop
            groups.append(group)
        links = Counter()
        for x, y in groups:
            for (i, n), (j, m) in ((p, q) for p in Counter(x).items() for q in Counter(y).items()):
                links[i, j] += n * m
        counts.update(links.keys())
        found.append((len(ids[0]), len(ids[1]), groups, links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        right = sum(n for p, n in f[3].items() if counts[p] == best[p[0]])
        out.append((f[0], f[1], len(f[2]), sum(f[3].values()), right, sum(n * counts[p] for p, n in f[3].items()), hashlib.sha256(groups.encode()).hexdigest()))
    return out


def _running(spelled):
    at = 0
    for s in spelled:
        at += len(s)
        yield at


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", "a  b", " lead", "trail ", "x \n y", "x\n \n y", "tab\t z", "<|endoftext|> and <s>", "▁u", "a▁b", "中文 字 符", "🙂 🙂🙂  ok",
    "　wide 　x", "nb  sp", "'s it's I'LL", "a" * 5000, "=-" * 3000, " " * 300, "\0 \1 z", "1 22 333 4444", "\n\n\n", "x \x85y", "\x1c a \x1d b",
]


@pytest.mark.parametrize("hot, large", [(1 << 20, 1 << 16), (40, 2)])
def test_alignment_agrees_with_the_libraries(spark, libraries, monkeypatch, hot, large):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "中", "🙂", "1", "9", "_", "-", "!", " ", "　", "\x1f", "\x85", "the", "ing", " of"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["the same text again"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = alignment.ByteRanks(tokenizer_file("byte_bpe_50k.json")), alignment.Pieces(tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in alignment.align(df, a, b, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts, libraries)


def test_large_groups_and_many_links_are_counted_whole():
    class Ids:
        sizes_a, sizes_b = range(50), range(40)

    import numpy as np

    found = alignment.Aligned.__new__(alignment.Aligned)
    rnd = np.random.default_rng(3)
    found.chunks, found.a, found.b = Ids, rnd.integers(0, 50, 700).astype(np.int32), rnd.integers(0, 40, 650).astype(np.int32)
    found.in_a, found.in_b, found.text = np.array([300, 1, 2, 397]), np.array([3, 1, 400, 246]), np.array([0, 0, 1, 1])
    found.last_a, found.last_b = np.cumsum(found.in_a) - 1, np.cumsum(found.in_b) - 1
    want = Counter()
    for g in range(4):
        for x in found.a[found.last_a[g] - found.in_a[g] + 1 : found.last_a[g] + 1].tolist():
            for y in found.b[found.last_b[g] - found.in_b[g] + 1 : found.last_b[g] + 1].tolist():
                want[int(found.text[g]), x * 40 + y] += 1
    for alignment_large, expanded in ((1 << 16, 1 << 22), (100, 1 << 22), (100, 64), (1 << 20, 64)):
        before = alignment.LARGE_GROUP, alignment.EXPANDED
        alignment.LARGE_GROUP, alignment.EXPANDED = alignment_large, expanded
        try:
            assert {(t, p): n for t, p, n in zip(*(x.tolist() for x in found.pairs()))} == want
        finally:
            alignment.LARGE_GROUP, alignment.EXPANDED = before


def test_gallop_finds_every_place():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 3000), (3000, 5), (700, 700), (9, 17)):
        ends = np.unique(rnd.integers(1, 10_000, n))
        wanted = np.unique(np.append(rnd.integers(1, ends[-1] + 1, m), ends[-1]))
        assert alignment.gallop(wanted, ends).tolist() == np.searchsorted(ends, wanted).tolist()


def test_spans_are_real_outputs(spark, libraries):
    import numpy as np

    a, b = alignment.ByteRanks(tokenizer_file("byte_bpe_50k.json")), alignment.Pieces(tokenizer_file("piece_bpe_32k.model"))
    text = "Ärger mit unaligned tokenizations, 12345 times.\n\nTwice"
    row = alignment.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), a, b, outputs=("a_ids", "b_ids", "a_per_group", "b_per_group", "groups")).first()
    ids = lambda x: np.frombuffer(x, "<u4").tolist()
    assert ids(row.a_ids) == libraries[0].encode(" " + text, add_special_tokens=False).ids and ids(row.b_ids) == libraries[1].encode(text)
    assert sum(ids(row.a_per_group)) == row.n_a and sum(ids(row.b_per_group)) == row.n_b and len(row.groups.split(";")) == row.n_groups == len(ids(row.a_per_group))


def plain_fill(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), output, text


def test_fill_middle_agrees_with_brute_force(spark):
    base = [None, "", "a", "ab c", " é中🙂\n\0x", "<P>q", "x<S", "<", "word word <M", "<S<P>x", "P>", "<<P<S<M"]
    rows = [(i, t) for i, t in enumerate(base * 25)] + [(None, "no key"), (None, None), (5, "long " * 300_000), (6, "é" * 200_000), (0, "again"), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS n", "1 AS extra", "2 AS __h1")
    got = fill_middle.restore(fill_middle.fill_middle(df))
    assert got.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got.collect()] == [plain_fill(*r) for r in rows]


def test_language_models_recognise_held_out_texts(spark):
    got = queries.op13_language_id(spark, SF.replace("sf0.001", "sf0.01"))
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in held) < 0.03 * len(held)


def test_language_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("mine").alias("score"))
    some = spark.createDataFrame([(-1, None, "en"), (-2, "", "fr"), (-3, "12 .. 34", None), (None, "the and of the", None), (-4, "der " * 300_000, None)], "doc_id long, text string, lang string")
    both = docs.unionByName(some.withColumn("score", F.lit("mine")))
    out = language_id.identify(both, F.col("doc_id") > 0)
    rows = {r.doc_id: r for r in out.where("doc_id is null or doc_id < 0").collect()}
    assert [rows[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and all(rows[i].score == 0 for i in (-1, -2, -3))
    assert rows[None].lang_pred in ("en", "fr", "de", "es") and rows[-4].lang_pred == "de"
    nothing = language_id.identify(both, F.lit(False))
    assert {r.lang_pred for r in nothing.select("lang_pred").distinct().collect()} == {"und"}
    assert language_id.identify(both.where("false"), F.lit(True)).columns == out.columns


def test_language_models_of_more_languages_than_fit_one_pass(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    whole = {r.doc_id: (r.lang_pred, round(r.bits, 4) if r.bits else None) for r in language_id.identify(docs, F.lit(True)).collect()}
    monkeypatch.setattr(language_id, "AT_ONCE", 1)
    assert {r.doc_id: (r.lang_pred, round(r.bits, 4) if r.bits else None) for r in language_id.identify(docs, F.lit(True)).collect()} == whole


def test_kneser_ney_agrees_with_a_plain_model(spark):
    """Probabilities of one small text against counters."""
    import numpy as np

    texts = ["banana bandana", "ban an a", "nab"]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    model = language_id.Models(["x"], language_id.folded(language_id.gram_counts(df, "text", "lang")).toArrow())
    grams = np.concatenate([language_id.gram_codes([t])[0] for t in texts])
    counts = {4: Counter(grams.tolist())}
    for k in (3, 2, 1):
        counts[k] = Counter(g & language_id._mask(k) for g in counts[k + 1])

    def p(gram, k):
        if k == 0:
            return 1 / 4096
        code = gram & language_id._mask(k)
        mine = {g: n for g, n in counts[k].items() if g >> 12 == code >> 12}
        ones, twos = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        d = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
        if not mine:
            return p(gram, k - 1)
        return (max(counts[k][code] - d, 0) + d * len(mine) * p(gram, k - 1)) / sum(mine.values())

    want = [-np.log2(p(int(g), 4)) for g in grams]
    assert np.allclose(model.bits(grams)[:, 0], want, atol=1e-4)
