"""Language identification (13): interpolated Kneser-Ney character models, one for each language.

Texts become lower-case letters with one blank between words. All texts to learn from are counted: each task counts the
four-grams of its slices, Spark sums them by language and derives what lower orders need (in how many contexts a shorter gram
occurs) and every history's total and number of continuations. The sums are folded into FOLD hash values for each order and language,
so that a model has a size that doesn't grow with the corpus; those of a few languages at a time are sent to the tasks as sorted hash arrays
with binary search. More languages take more passes over the texts. A text gets the language of lowest cross-entropy by symbol.

A part of the texts to learn from is left out of the counts and calibrates: the share of right answers by the lead over the second language
gives the score, and the distance from the language's usual cross-entropy the limit beyond which an answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sundew.llm._arrow import small_batches, text_slices
from sundew.llm._hashing import finish
from sundew.llm.byte_bpe import LETTER, classes
from sundew.plans.tables import materialize, release

#: Symbols of a gram, and bits of a symbol: 0 is a blank, letters are hashed to the other values.
ORDER, BITS = 4, 12
#: Hash values of an order (a prime), languages whose models a task holds at once, and most languages that can be learned.
FOLD, AT_ONCE, MOST_LANGUAGES = 524_269, 4, 512
#: Symbols that are counted or scored at once; longer texts are cut, and each part begins with a blank.
PART = 1 << 19
#: Grams that a task holds before it sends their counts on, and scores that it remembers.
HELD, REMEMBERED = 2_000_000, 500_000
#: One in so many texts to learn from calibrates; bins of the lead, in bits by symbol; the share of calibrating texts beyond a
#: distance, and how many times that distance the limit is.
CALIBRATING, LEAD_BINS, LEAD_MOST, REJECTED, BEYOND = 8, 64, 2.0, 0.001, 1.5
UNDETERMINED = "und"


def _mask(order: int) -> int:
    return (1 << BITS * order) - 1


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of ORDER symbols that end at every symbol of the texts, packed, and the text of each. A text begins in blanks."""
    pad = "\0" * (ORDER - 1)
    joined = pad + pad.join(texts) + pad
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = classes()[codes] == LETTER
    keep = letter | (codes == 0)
    keep[1:] |= letter[:-1]  # of other characters only the first after a letter
    kept = codes[keep]
    symbols = np.where(letter[keep], finish(kept.astype(np.uint64)) % np.uint64((1 << BITS) - 1) + np.uint64(1), np.uint64(0)).astype(np.int64)
    grams = symbols.copy()
    for back in range(1, ORDER):
        grams[back:] |= symbols[:-back] << BITS * back
    counted = symbols > 0
    counted[1:] |= symbols[:-1] > 0  # a word's end is a symbol too
    following = np.cumsum([len(t) + ORDER - 1 for t in texts]) + ORDER - 1  # where the next text starts
    return grams[counted], np.searchsorted(following, np.flatnonzero(keep)[counted], side="right")


def parts(raws: list[bytes | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in lower case as lists of about PART characters, with their rows; a longer text is cut."""
    rows: list[int] = []
    texts: list[str] = []
    held = 0
    for row, raw in enumerate(raws):
        text = (raw or b"").decode("utf-8", "replace").lower()
        for at in range(0, len(text), PART):
            rows.append(row)
            texts.append(text[at : at + PART])
            held += len(texts[-1])
            if held >= PART:
                yield rows, texts
                rows, texts, held = [], [], 0
    if texts:
        yield rows, texts


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(codes, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def gram_counts(df: DataFrame, text: str, language: str) -> DataFrame:
    """``lang, code, n``: how often every gram occurs in the texts of each language. Tasks send sums, so a frequent gram is a few rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                codes, counts = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
                for at in range(0, len(codes), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes[cut])), pa.array(codes[cut]), pa.array(counts[cut])], names=["lang", "code", "n"])

        for batch in batches:
            for start, stop in text_slices(batch, text):
                part = batch.slice(start, stop - start)
                langs = part.column(language).to_pylist()
                for rows, texts in parts(part.column(text).cast(pa.binary()).to_pylist()):
                    grams, of = gram_codes(texts)
                    own = np.array([langs[r] for r in rows], object)[of]
                    for lang in dict.fromkeys(langs[r] for r in rows):
                        codes, counts = np.unique(grams[own == lang], return_counts=True)
                        held.setdefault(lang, []).append((codes, counts))
                        size += len(codes)
                if size > HELD:
                    held = {k: [_summed(*(np.concatenate(x) for x in zip(*v, strict=True)))] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield from sums()
                        held, size = {}, 0
        yield from sums()

    return small_batches(df.select(text, language)).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def folded(counts: DataFrame) -> DataFrame:
    """``lang, ord, history, at, n, kinds``: grams and histories of every order in FOLD hash values, and the counts that discounts are made of.

    A gram of the highest order counts as often as it occurs, a shorter one once for each symbol that comes before it.
    """
    tables, at_order = [], counts
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            at_order = at_order.groupBy("lang", F.col("code").bitwiseAND(F.lit(_mask(order))).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        ones = F.struct(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
        for history, code in ((False, F.col("code")), (True, F.shiftright("code", BITS))):
            sums = at_order.groupBy("lang", (code % FOLD).alias("at")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), ones.alias("o"))
            tables.append(sums.select("lang", F.lit(order).alias("ord"), F.lit(history).alias("history"), "at", "n", "kinds", "o.ones", "o.twos"))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


class Models:
    """Models of a few languages as sorted hash arrays; ``bits`` scores grams by all of them."""

    def __init__(self, languages: list[str], table: pa.Table):
        self.languages = languages
        number = {lang: i for i, lang in enumerate(languages)}
        lang = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
        order, history, at, n, kinds, ones, twos = (table.column(c).to_numpy() for c in ("ord", "history", "at", "n", "kinds", "ones", "twos"))
        self.orders = []
        for k in range(1, ORDER + 1):
            arrays = []
            for kind, values in ((False, (n,)), (True, (n, kinds))):
                mine = np.flatnonzero((order == k) & (history == kind))
                keys = lang[mine] * FOLD + at[mine]
                by = np.argsort(keys)
                arrays.append((keys[by], *(v[mine][by].astype(np.float32) for v in values)))
            one, two = (np.bincount(lang[(order == k) & ~history], v[(order == k) & ~history], len(languages)) for v in (ones, twos))
            discount = np.where(one > 0, one / np.maximum(one + 2 * two, 1), 0.5).clip(0.1, 0.95)
            self.orders.append((arrays[0], arrays[1], discount))

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """Values of the wanted keys by binary search, 0 where there is none."""
        if not len(keys):
            return [np.zeros(len(wanted)) for _ in values]
        at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
        hit = keys[at] == wanted
        return [np.where(hit, v[at], 0.0) for v in values]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last symbol of every gram, one column for each language."""
        out = np.empty((len(grams), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            p = np.full(len(grams), 1 / (1 << BITS))
            for k, (gram, history, discount) in enumerate(self.orders, 1):
                code = grams & _mask(k)
                (n,) = self.find(gram[0], i * FOLD + code % FOLD, gram[1])
                total, kinds = self.find(history[0], i * FOLD + (code >> BITS) % FOLD, history[1], history[2])
                d = discount[i]
                p = np.where(total > 0, (np.maximum(n - d, 0) + d * kinds * p) / np.maximum(total, 1), p)
            out[:, i] = -np.log2(p)
        return out


_BEST = "__best string, __bits double, __second double, __symbols long"


def scored(df: DataFrame, text: str, models: Models) -> DataFrame:
    """Take the models' languages into the best and second-best cross-entropy by symbol that the rows have so far."""
    out = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = np.zeros(0, np.int64), np.zeros((0, len(models.languages)), np.float32)
        for batch in batches:
            for start, stop in text_slices(batch, text):
                part = batch.slice(start, stop - start)
                sums, symbols = np.zeros((part.num_rows, len(models.languages))), np.zeros(part.num_rows, np.int64)
                for rows, texts in parts(part.column(text).cast(pa.binary()).to_pylist()):
                    grams, of = gram_codes(texts)
                    if not len(grams):
                        continue
                    different, where = np.unique(grams, return_inverse=True)
                    new = np.setdiff1d(different, known, assume_unique=True)
                    if len(new):
                        if len(known) + len(new) > REMEMBERED:
                            new, known, values = different, known[:0], values[:0]
                        both, rated = np.concatenate([known, new]), np.concatenate([values, models.bits(new)])
                        by = np.argsort(both)
                        known, values = both[by], rated[by]
                    rated = values[np.searchsorted(known, different)][where]
                    row = np.array(rows)[of]
                    symbols += np.bincount(row, minlength=part.num_rows)
                    for i in range(len(models.languages)):
                        sums[:, i] += np.bincount(row, rated[:, i], part.num_rows)
                mean = np.where(symbols[:, None] > 0, sums / np.maximum(symbols, 1)[:, None], np.nan)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out.names[:-4]), *_merged(part, mean, symbols, models.languages)], names=out.names)

    return small_batches(df).mapInArrow(run, out)


def _merged(part: pa.RecordBatch, mean: np.ndarray, symbols: np.ndarray, languages: list[str]) -> list[pa.Array]:
    best = part.column("__best").to_pylist()
    first, second = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("__bits", "__second"))
    for i, lang in enumerate(languages):
        better = mean[:, i] < first
        second = np.where(better, first, np.where(mean[:, i] < second, mean[:, i], second))
        first = np.where(better, mean[:, i], first)
        best = [lang if b else old for b, old in zip(better.tolist(), best, strict=True)]
    return [pa.array(best, pa.string()), pa.array(first), pa.array(second), pa.array(symbols)]


def rising(right: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The share of right answers in every bin, made to rise by pooling neighbours, a half in bins before anything is known."""
    pools: list[list[float]] = []
    for r, a in zip(right + 0.5, all_ + 1.0, strict=True):
        pools.append([r, a, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            r2, a2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + r2, pools[-1][1] + a2, pools[-1][2] + n2]
    return np.concatenate([[r / a] * int(n) for r, a, n in pools])


def identify(
    df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", language: str = "lang", keep: list[str] | None = None
) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``rejected`` and ``bits`` to the columns ``keep``, all by default.

    Learned from all rows where ``learn`` holds and the language isn't null; those of one in CALIBRATING hash values of the key only calibrate.
    ``lang_pred`` is a learned language, or ``und`` for null texts, texts without a letter, and where nothing could be learned; ties go to
    the first language in order of name. ``score`` is the share of right answers among calibrating texts with such a lead, 0 for ``und`` and for rejected rows:
    those whose ``bits`` (cross-entropy by symbol), weighed by length, are BEYOND times further above the language's mean than all but REJECTED
    of the calibrating texts. Nothing but the text enters a prediction, so repeated rows get equal ones. An empty table gives an empty result; computed
    columns replace input columns of their names. Very long texts are scored in parts of PART symbols.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected", "bits")]
    given = df.withColumns({"__learn": learn & F.col(language).isNotNull() & F.col(text).isNotNull()})
    some = F.pmod(F.xxhash64(F.lit(13), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(CALIBRATING)) == 0
    models, held = _learned(given.where(F.col("__learn")), text, language, some)
    rows = df.select(*dict.fromkeys([*keep, text]))
    mark, calibration = _verdict(_rated(given.where(F.col("__learn") & some).select(text, F.col(language).alias("__lang")), text, models))
    if held:
        release(held)
    rated = _rated(rows, text, models)
    sure = F.element_at(F.array(*map(F.lit, mark.tolist())), _lead() + 1)
    z = lambda mean: (F.col("__bits") - mean) * F.sqrt(F.least("__symbols", F.lit(256)))
    far = F.lit(False)
    for lang, (mean, limit) in calibration.items():
        far = F.when(F.col("__best") == lang, z(F.lit(mean)) > limit).otherwise(far)
    known = F.col("__best").isNotNull() & (F.col("__symbols") > 0)
    return rated.select(
        *keep, F.when(known, F.col("__best")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(known & ~far, sure).otherwise(0.0).alias("score"),
        (known & far).alias("rejected"), F.when(known, F.col("__bits")).alias("bits"),
    )


def _learned(rows: DataFrame, text: str, language: str, calibrates: Column) -> tuple[list[Models], DataFrame | None]:
    languages = [r[0] for r in rows.select(language).distinct().orderBy(language).limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return [], None
    counted = materialize(gram_counts(rows.where(~calibrates), text, language), "language-grams")
    model = materialize(folded(counted), "language-models")
    release(counted)
    some = [languages[i : i + AT_ONCE] for i in range(0, len(languages), AT_ONCE)]
    return [Models(group, model.where(F.col("lang").isin(group)).toArrow()) for group in some], model


def _rated(rows: DataFrame, text: str, models: list[Models]) -> DataFrame:
    most = F.lit(float("inf"))
    rows = rows.select("*", F.lit(None).cast("string").alias("__best"), most.alias("__bits"), most.alias("__second"), F.lit(0).cast("long").alias("__symbols"))
    for group in models:
        rows = scored(rows, text, group)
    return rows


def _lead() -> Column:
    """The bin of the best language's lead over the second, which is at most what all symbols alike would cost."""
    ahead = F.least("__second", F.lit(float(BITS))) - F.least("__bits", F.lit(float(BITS)))
    return F.least(F.floor(F.greatest(ahead, F.lit(0.0)) / LEAD_MOST * LEAD_BINS), F.lit(LEAD_BINS - 1)).cast("int")


def _verdict(rated: DataFrame) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Scores by lead, and for each language its mean cross-entropy and the limit, both of bounded size whatever the table has."""
    rated = materialize(rated.where("__best is not null").select("__lang", "__best", "__bits", "__second", "__symbols"), "language-calibration")
    bins = rated.groupBy(_lead().alias("bin")).agg(F.count_if(F.col("__lang") == F.col("__best")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
    right, total = np.zeros(LEAD_BINS), np.zeros(LEAD_BINS)
    for r in bins:
        right[r.bin], total[r.bin] = r.right, r.n
    means = rated.groupBy("__best").agg(F.avg("__bits").alias("mean"))
    z = ((F.col("__bits") - F.col("mean")) * F.sqrt(F.least("__symbols", F.lit(256)))).alias("z")
    limits = rated.join(F.broadcast(means), "__best").select("__best", "mean", z).groupBy("__best", "mean").agg(F.percentile_approx("z", 1 - REJECTED, 10_000).alias("limit"))
    found = {r["__best"]: (r["mean"], max(r["limit"], 0.0) * BEYOND) for r in limits.collect()}
    release(rated)
    return rising(right, total), found
