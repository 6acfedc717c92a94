"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language: character n-grams up to order 4 over letters, other characters folded to a
space. Probabilities are stored in back-off form: a sorted array of 64-bit n-gram hashes beside
their log probabilities, and one of context hashes beside their back-off weights. A batch of texts
is hashed at once, each distinct 4-gram is looked up once per language, and per-document sums give
the cross-entropy per character. The lowest one wins; it is rejected where it lies further above
its language's mean than all but a stated share of labelled documents that the model has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, worker_cache

U = np.uint64
ORDER = 4
#: Labelled documents per language that a model is fitted on, about: a seeded hash keeps this share.
SAMPLE = 2000
#: Of ten sampled documents this many calibrate the rejection instead of being counted.
CALIBRATION_TENTHS = 2
#: Share of a language's documents that may be rejected: the limit is the order statistic of the
#: calibration documents' excess that a further one passes with this probability at most (split
#: conformal). With under 1 / FALSE_REJECTION of them it is their largest, at a rate of 1 / (n + 1).
FALSE_REJECTION = 0.005
#: Documents under LONG characters tell how the excess grows as they get shorter, the others what is left of it.
LONG = 200
#: A language with fewer calibration documents takes the limit of those that have as many, together.
CALIBRATED = 20
UNKNOWN = "und"
TABLE_BITS = 20
#: Characters hashed at a time; a longer text is one batch of its own.
CHARS = 1 << 20


def letters_table() -> np.ndarray:
    return worker_cache("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, folded, each after ORDER-1 spaces and before one; starts; letters in each."""
    table, parts, letters = letters_table(), [], []
    pad = np.full(ORDER - 1, 32, np.uint32)
    for t in texts:
        points = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        good = table[points]
        keep = good.copy()
        keep[1:] |= good[:-1]
        parts += [pad, np.where(good, points, np.uint32(32))[keep], pad[:1]]
        letters.append(int(good.sum()))
    starts = np.concatenate(([0], np.cumsum([sum(len(p) for p in parts[i : i + 3]) for i in range(0, len(parts), 3)])))
    return np.concatenate(parts or [pad]), starts.astype(np.int64), np.array(letters, np.int64)


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """hashes[n-1][i]: of the n-gram that ends at i+n-1, so that longer ones extend to the left."""
    unit = mixed(codes.astype(U) + U(1))
    out = [unit]
    for n in range(2, ORDER + 1):
        out.append(mixed(out[-1][1:] * U(0x9E3779B97F4A7C15) + unit[: len(unit) - n + 1]))
    return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one occurrence of each value, and each element's number among them."""
    n = len(h)
    slot = (h >> U(64 - TABLE_BITS)).astype(np.int64)
    table = worker_cache("slots", lambda: np.empty(1 << TABLE_BITS, np.int64))
    table[slot] = np.arange(n)
    chosen = table[slot]
    odd = np.flatnonzero(h[chosen] != h)  # another value took the slot
    if len(odd):
        _, first, back = np.unique(h[odd], return_index=True, return_inverse=True)
        chosen[odd] = odd[first][back]
    used = np.zeros(n, bool)
    used[chosen] = True
    where = np.flatnonzero(used)
    number = np.empty(n, np.int64)
    number[where] = np.arange(len(where))
    return where, number[chosen]


def batches_of(texts: list):
    """Slices of about CHARS characters; texts are never cut."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHARS:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t or "") + ORDER
    if begin < len(texts):
        yield slice(begin, len(texts))


def count_grams(batches):
    """(lang, gram, n): 4-grams of each language in a batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for part in batches_of(own):
                codes, starts, _ = codes_of(own[part])
                hashes = gram_hashes(codes)[-1]
                inside = np.ones(len(hashes), bool)
                for s in starts[1:-1]:
                    inside[s - ORDER + 1 : s] = False
                at = np.flatnonzero(inside)
                where, number = distinct(hashes[at])
                grams = [codes[i : i + ORDER].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for i in at[where]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.bincount(number, minlength=len(where)).astype(np.int64))], names=["lang", "gram", "n"])


def kneser_ney(grams: list[str], counts: list[int]) -> dict:
    """Back-off form of the interpolated model: sorted hashes and log probabilities of each order, and of the contexts' weights."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    hashes = []
    unit = mixed(codes.astype(U) + U(1))
    h = unit[:, -1]
    hashes.append(h)
    for n in range(2, ORDER + 1):
        h = mixed(h * U(0x9E3779B97F4A7C15) + unit[:, ORDER - n])
        hashes.append(h)
    contexts = [np.zeros(len(codes), U)]
    h = unit[:, -2]
    contexts.append(h)
    for n in range(2, ORDER):
        h = mixed(h * U(0x9E3779B97F4A7C15) + unit[:, ORDER - 1 - n])
        contexts.append(h)
    model: dict = {"grams": [], "contexts": []}
    count = np.array(counts, np.float64)
    tables = [None] * ORDER  # of each order: gram hash, context hash, lower order's hash, count
    tables[-1] = (hashes[-1], contexts[-1], hashes[-2], count)
    for n in range(ORDER - 1, 0, -1):  # counts of lower orders: different characters to the left
        longer, first = np.unique(hashes[n], return_index=True)
        short, at, back = np.unique(hashes[n - 1][first], return_index=True, return_inverse=True)
        pick = first[at]
        tables[n - 1] = (short, contexts[n - 1][pick], hashes[n - 2][pick] if n > 1 else np.zeros(len(short), U), np.bincount(back, minlength=len(short)).astype(np.float64))
        del longer
    vocabulary = len(tables[0][0]) + 1
    lower: tuple | None = None
    for gram, context, short, c in tables:
        once, twice = float((c == 1).sum()), float((c == 2).sum())
        discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        which, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, weights=c)
        weight = discount * np.bincount(back) / total
        below = np.full(len(gram), 1 / vocabulary) if lower is None else lower[1][np.searchsorted(lower[0], short)]
        p = np.maximum(c - discount, 0) / total[back] + weight[back] * below
        order = np.argsort(gram)
        lower = (gram[order], p[order])
        model["grams"].append((gram[order], np.log(p[order]).astype(np.float32)))
        model["contexts"].append((which, np.log(weight).astype(np.float32)))
    model["floor"] = float(np.log(1 / vocabulary))
    return model


def look_up(table: tuple, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = table
    if not len(hashes):
        return np.full(len(keys), default, np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    found = hashes[at] == keys
    return np.where(found, values[at], np.float32(default)), found


def log_probability(model: dict, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
    """Of each 4-gram's last character after the others; grams and contexts by order."""
    out = np.full(len(grams[0]), model["floor"], np.float32)
    for n in range(ORDER):
        weight, _ = look_up(model["contexts"][n], contexts[n], 0.0)
        value, found = look_up(model["grams"][n], grams[n], 0.0)
        out = np.where(found, value, out + weight)
    return out


def entropies(models: list[dict], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropy per character (a row for each text, a column for each model), characters, letters."""
    codes, starts, letters = codes_of(texts)
    hashes = gram_hashes(codes)
    n = len(hashes[-1])
    where, number = distinct(hashes[-1])
    grams = [hashes[k][where + ORDER - 1 - k] for k in range(ORDER)]
    contexts = [np.zeros(len(where), U)] + [hashes[k - 1][where + ORDER - 1 - k] for k in range(1, ORDER)]
    begin, stop = starts[:-1], starts[1:] - ORDER + 1  # 4-grams that lie within the text
    sizes = np.maximum(stop - begin, 1)
    out = np.zeros((len(texts), len(models)))
    for j, m in enumerate(models):
        sums = np.concatenate(([0.0], np.cumsum(log_probability(m, grams, contexts)[number], dtype=np.float64)))
        out[:, j] = -(sums[np.minimum(stop, n)] - sums[np.minimum(begin, n)]) / sizes
    return out, sizes, letters


def judge_for(names: list[str], models: list[dict], limits: list[tuple]):
    """Language, score, cross-entropy and acceptance of each of some texts."""

    def judged(own):
        if not names:
            nothing = np.zeros(len(own))
            return [UNKNOWN] * len(own), nothing, nothing * np.nan, codes_of(own)[2] > 0
        h, sizes, letters = entropies(models, own)
        best = h.argmin(axis=1)
        least = h[np.arange(len(own)), best]
        some = letters > 0
        share = 1 / np.exp(-(h - least[:, None]) * np.minimum(sizes, 40)[:, None]).sum(axis=1)
        mean, between, within, most = np.array(limits).T[:, best]
        accepted = some & (excess(least, sizes, mean, between, within) <= most)
        lang = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        score, entropy = np.where(some, share, 0.0), np.where(some, least, np.nan)
        return lang, score, entropy, accepted

    return judged


def predict_for(*fitted):
    judged = judge_for(*fitted)

    def predict(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in batches_of(texts):
                own = [t or "" for t in texts[part]]
                lang, score, entropy, accepted = judged(own)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(accepted)], names=["key", "lang_pred", "score", "cross_entropy", "accepted"])

    return predict


def keep_for(column: int, *fitted):
    judged = judge_for(*fitted)

    def keep(batches):
        for batch in batches:
            texts = batch.column(column).to_pylist()
            for part in batches_of(texts):
                accepted = judged([t or "" for t in texts[part]])[3]
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(accepted))

    return keep


def keep_known(docs: DataFrame, fitted: tuple, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text a learned language accepts; where none was learned, those with a letter."""
    return docs.mapInArrow(keep_for(docs.columns.index(text), *fitted), docs.schema)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def excess(h: np.ndarray, n: np.ndarray, mean, between, within) -> np.ndarray:
    """How far cross-entropies lie above the mean, in deviations that n characters let expect."""
    return (h - mean) / np.sqrt(between**2 + within**2 / n)


def limit(h: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """(mean, deviation between documents, deviation of a character, largest excess accepted) from calibration documents' cross-entropies and sizes."""
    mean = float((h * n).sum() / n.sum())
    off = np.square(h - mean)
    between, within = (float(np.sqrt(np.median(x))) if len(x) else 0.0 for x in (off[n >= LONG], (off * n)[n < LONG]))
    between, within = max(between, 0.01), within or 1.0
    found = np.sort(excess(h, n, mean, between, within))
    return mean, between, within, float(found[min(len(found), int(np.ceil((len(found) + 1) * (1 - FALSE_REJECTION)))) - 1])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], list[dict], list[tuple]]:
    """Languages, their models and their limits for rejection, from labelled rows.

    About `sample` documents of each language are used, chosen by a seeded hash of key and text,
    which bounds what reaches the driver. Rows with a null text or language are left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna(subset=["text", "lang"])
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return [], [], []
    million = 1_000_000
    share = rows.sparkSession.createDataFrame([(k, min(million, -(-sample * million // n))) for k, n in totals.items()], "lang string, share int")
    draw = F.pmod(F.xxhash64(F.lit(11), "key", "text"), F.lit(million))
    rows = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")) if len(totals) <= 10_000 else rows.join(share, "lang").where(draw < F.col("share"))
    held = F.pmod(F.xxhash64(F.lit(12), "key", "text"), F.lit(10)) < CALIBRATION_TENTHS
    counted = rows.where(~held).select("lang", "text").mapInArrow(count_grams, "lang string, gram string, n long")
    grams: dict[str, tuple[list, list]] = {}
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        a, b = grams.setdefault(r["lang"], ([], []))
        a.append(r["gram"]), b.append(r["n"])
    names = sorted(grams)
    models = [kneser_ney(*map(list, zip(*sorted(zip(*grams[x], strict=True)), strict=True))) for x in names]

    def residuals(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in batches_of(texts):
                h, sizes, letters = entropies(models, texts[part])
                own = [names.index(x) if x in names else -1 for x in langs[part]]
                ok = np.array(own) >= 0
                yield pa.RecordBatch.from_arrays([pa.array(langs[part]).filter(pa.array(ok)), pa.array(h[np.arange(len(own)), own][ok]), pa.array(sizes[ok]), pa.array(letters[ok])], names=["lang", "h", "n", "letters"])

    seen = rows.where(held).select("lang", "text").mapInArrow(residuals, "lang string, h double, n long, letters long").where("letters > 0").collect()
    excerpt = {x: tuple(np.array([r[c] for r in seen if r["lang"] == x], float) for c in ("h", "n")) for x in names}
    sure = [x for x in names if len(excerpt[x][0]) >= CALIBRATED] or names
    pooled = tuple(np.concatenate([excerpt[x][c] for x in sure] or [np.empty(0)]) for c in (0, 1))
    limits = []
    for x, model in zip(names, models, strict=True):
        own = excerpt[x] if len(excerpt[x][0]) >= CALIBRATED else pooled
        # too few even together: no text may cost more than its model's own characters in random order
        limits.append(limit(*own) if len(own[0]) >= CALIBRATED else (-model["floor"], 1.0, 0.0, 0.0))
    return names, models, limits


def identify(docs: DataFrame, fitted: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, cross_entropy, accepted) for every row, in one pass.

    `key` must be an integer. Null texts and texts without a letter give `und`, score 0 and accepted false. Where no language
    was learned every text gives `und` and score 0, and those with a letter are accepted. Repeated rows give a row each; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(predict_for(*fitted), "key long, lang_pred string, score double, cross_entropy double, accepted boolean").withColumnRenamed("key", key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fitted = fit(docs.where(fold(F.col("doc_id")) != 0))
    found = identify(docs.select("doc_id", "text"), fitted)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")
