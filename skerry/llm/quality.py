"""Problem 10: text statistics of each document, and a Gaussian mixture that tells prose from lists, tables and junk."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.shingles import portions
from skerry.runtime import staged

#: Common words of English, French, German and Spanish (fixed values).
COMMON = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his this are or at from which but have an had they you were their one all we can her has there been if more when will would who so no out up its our any each such may should could
    le la les de des du un une et est en que qui dans pour pas sur au aux avec ce cette ces il elle ne se plus par sont ou mais nous vous leur son sa ses été sans selon être ont
    der die das und ist in den von zu mit sich des auf für nicht im dem ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis gegen ohne
    el la los las de del y que en un una es por con no se su para al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está contra según
    """.split()
)
STATS = (
    "n_words", "mean_word", "symbol_ratio", "digit_ratio", "upper_ratio", "common_share", "sentence_lines", "words_per_line", "short_lines", "separator_rate",
    "bullet_lines", "distinct_share", "long_words", "odd_letters", "sentence_length", "number_words", "pair_share", "single_letters", "inner_symbols",
)
CLASSES = ("prose", "list", "table", "junk")

_bullet = re.compile(r"^\s*(?:[-*•‣–—·o]\s|\(?[0-9a-zA-Z]{1,3}[.)]\s)", re.M)
_stop = re.compile(r"[.!?…](?=[\s\"'”»)]|$)")
LETTER, DIGIT, SPACE, UPPER, SYMBOL, END, CLOSE, TRAIL = (np.uint8(1 << i) for i in range(8))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Kinds and lower case of the code points under 0x3000."""
    kind, low = np.zeros(0x3000, np.uint8), np.arange(0x3000, dtype=np.uint32)
    for i in range(0x3000):
        ch = chr(i)
        cat = unicodedata.category(ch)
        k = 0
        if cat[0] == "L":
            k |= LETTER
            if len(ch.lower()) == 1:
                low[i] = ord(ch.lower())
        elif cat == "Nd":
            k |= DIGIT
        elif ch.isspace():
            k |= SPACE
        elif ch not in ".,;:!?'\"()’“”«»%$€£-_" and cat[0] not in "NM":
            k |= SYMBOL
        if "A" <= ch <= "Z":
            k |= UPPER
        if ch in ".!?…:":
            k |= END
        if ch in "'\"”»)":
            k |= CLOSE
        if 0x80 <= i <= 0xBF or ch in "‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€":
            k |= TRAIL
        kind[i] = k
    return kind, low


_KIND, _LOW = _classes()
_POWER = np.cumprod(np.concatenate([[1], np.full(255, 0x100000001B3)]).astype(np.uint64))


def _hashes(cp: np.ndarray, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of characters: ``pos`` are their characters' places, ``length`` their lengths."""
    begin = np.cumsum(length) - length
    inside = (np.arange(len(pos)) - np.repeat(begin, length)) & 255
    h = np.add.reduceat((cp[pos].astype(np.uint64) + np.uint64(7)) * _POWER[inside], begin) + length.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _word_hash(word: str) -> int:
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return int(_hashes(cp, np.arange(len(cp)), np.array([len(cp)]))[0])


_COMMON = np.array(sorted(map(_word_hash, COMMON)), np.uint64)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of the figures named in ``STATS`` for each text, none of them blank; array operations over all texts' characters."""
    n = len(texts)
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    doc = np.repeat(np.arange(n), sizes + 1)
    near = np.minimum(cp, 0x2FFF)
    kind = _KIND[near]
    far = cp >= 0x3000
    if far.any():
        letters = ((cp >= 0x3040) & (cp < 0xD800)) | ((cp >= 0xF900) & (cp < 0xFB00)) | (cp >= 0x20000)
        kind = np.where(far, np.where(letters, LETTER, np.where(cp == 0x3000, SPACE, SYMBOL)), kind)
    cp = np.where(far, cp, _LOW[near])

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n).astype(float)

    def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.diff(mask.view(np.int8), prepend=0, append=0)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    letter, space, symbol = (kind & LETTER) > 0, (kind & SPACE) > 0, (kind & SYMBOL) > 0
    w0, w1 = runs(letter)
    length = w1 - w0
    wdoc = doc[w0]
    h = _hashes(cp, np.flatnonzero(letter), length) if len(w0) else np.zeros(0, np.uint64)
    w = np.bincount(wdoc, minlength=n).astype(float)
    w_ = np.maximum(w, 1)
    common = np.bincount(wdoc[np.isin(h, _COMMON)], minlength=n)

    def distinct(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        x = np.sort((x >> np.uint64(20)) | (owner.astype(np.uint64) << np.uint64(44)))
        return np.bincount((x[np.flatnonzero(np.diff(x, prepend=np.uint64(2**64 - 1)))] >> np.uint64(44)).astype(np.int64), minlength=n)

    same = np.flatnonzero(wdoc[1:] == wdoc[:-1])
    pairs = distinct(((h[same] * np.uint64(3)) ^ (h[same + 1] * np.uint64(0xD6E8FEB86659FD93))), wdoc[same])
    t0, t1 = runs(~space)
    tdoc = doc[t0]
    t = np.maximum(np.bincount(tdoc, minlength=n), 1).astype(float)
    number = ((kind[t0] | kind[t1 - 1]) & DIGIT) > 0
    line_ends = np.flatnonzero(cp == 10)
    starts = np.concatenate([[0], line_ends[:-1] + 1])
    place = np.where(space, -1, np.arange(len(cp)))
    last = np.maximum.reduceat(place, starts)
    full = last >= starts
    ldoc = doc[starts]
    k = np.maximum(np.bincount(ldoc[full], minlength=n), 1).astype(float)
    end = (kind[last] & END) > 0
    end |= ((kind[last] & CLOSE) > 0) & (last > starts) & ((kind[np.maximum(last - 1, 0)] & END) > 0)
    blanks = np.add.reduceat((cp == 32).astype(np.int32), starts)
    after = np.append(cp[1:], 10)
    wide0, wide1 = runs(cp == 32)
    separators = per_doc((cp == 0x7C) | (cp == 0x3B) | (cp == 9) | ((cp == 0x2C) & ~np.append(space[1:], True)))
    separators += np.bincount(doc[wide0[wide1 - wide0 >= 3]], minlength=n)
    between = symbol & np.concatenate([[False], letter[:-1]]) & np.append(letter[1:], False)
    odd = (np.isin(cp, (0xE3, 0xE2)) & ((_KIND[np.minimum(after, 0x2FFF)] & TRAIL) > 0)) | (cp == 0xFFFD)
    stops = np.fromiter((len(_stop.findall(x)) for x in texts), float, n)
    bullets = np.fromiter((len(_bullet.findall(x)) for x in texts), float, n)
    size = np.maximum(sizes, 1)
    out = [
        np.log1p(w),
        np.bincount(wdoc, weights=length, minlength=n) / w_,
        per_doc(symbol) / size,
        per_doc((kind & DIGIT) > 0) / size,
        per_doc((kind & UPPER) > 0) / size,
        np.log1p(40.0 * common / w_),
        np.bincount(ldoc[full & end], minlength=n) / k,
        np.log1p(t / k),
        np.bincount(ldoc[full & (blanks < 6)], minlength=n) / k,
        np.log1p(10.0 * separators / t),
        bullets / k,
        distinct(h, wdoc) / np.sqrt(2.0 * w_),
        np.bincount(tdoc[t1 - t0 > 20], minlength=n) / t,
        np.log1p(100.0 * per_doc(odd) / size),
        np.log1p(w / np.maximum(1, stops)),
        np.bincount(tdoc[number], minlength=n) / t,
        pairs / np.maximum(1, w - 1),
        np.log1p(100.0 * np.bincount(wdoc[length == 1], minlength=n) / w_),
        np.log1p(100.0 * per_doc(between) / w_),
    ]
    return np.stack(out, axis=1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in portions(texts, 500):
            x = statistics(texts[i:j])
            at = pa.array(np.arange(len(x) + 1) * len(STATS), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], ["doc_id", "x"])


def measured(documents: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the statistics, as an array in the order of ``STATS``, of each row whose text isn't null or blank."""
    rows = documents.select("doc_id", "text").filter(r"text IS NOT NULL AND text RLIKE '(?U)\\S'")
    return rows.mapInArrow(_measured, "doc_id long, x array<double>").distinct()


def text_statistics(documents: DataFrame) -> DataFrame:
    """``(doc_id, <STATS>...)``: one column a statistic; null and blank texts are left out, repeated rows count once."""
    return measured(documents).select("doc_id", *(F.round(F.col("x")[i], 6).alias(s) for i, s in enumerate(STATS)))


class Mixture:
    """A Gaussian mixture with full covariances over standardised statistics, and each component's classes."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, centres: np.ndarray, covariances: np.ndarray):
        self.mean, self.scale = mean, scale
        self.set(weights, centres, covariances)
        self.classes = np.full((len(weights), len(CLASSES)), 1.0 / len(CLASSES))

    def set(self, weights: np.ndarray, centres: np.ndarray, covariances: np.ndarray) -> None:
        self.weights, self.centres = weights, centres
        # A log density is linear in 1, the statistics and their products: one column a component.
        d = centres.shape[1]
        i, j = np.triu_indices(d)
        self.linear = np.empty((1 + d + len(i), len(weights)))
        for k, (w, c, cov) in enumerate(zip(weights, centres, covariances)):
            values, vectors = np.linalg.eigh(cov)
            values = np.maximum(values, 1e-2)
            a = (vectors / values) @ vectors.T
            self.linear[0, k] = math.log(max(w, 1e-12)) - 0.5 * (np.log(values).sum() + d * math.log(2 * math.pi) + c @ a @ c)
            self.linear[1 : 1 + d, k] = a @ c
            self.linear[1 + d :, k] = np.where(i == j, -0.5, -1.0) * a[i, j]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -12, 12)

    def posterior(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each component's share of each row, and each row's log likelihood."""
        return self.shared(expanded(z))

    def shared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of rows already ``expanded``."""
        log = x @ self.linear
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        s = p.sum(1, keepdims=True)
        return p / s, (top + np.log(s))[:, 0]


def expanded(z: np.ndarray) -> np.ndarray:
    """A one, the statistics, and the product of each two of them."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(STATS))


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The element-wise sum of all rows ``v`` of a partition."""
    total = None
    for b in batches:
        for i in range(b.num_rows):
            v = b.column(0)[i].values.to_numpy()
            total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], ["v"])


def examples(stats: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and class numbers of at most ``most`` labelled documents, those with the smallest hash.

    Null and unknown classes, documents without statistics and repeated rows are passed over; a
    document with two classes counts for both.
    """
    seen = labels.filter(F.col("text_class").isin(*CLASSES) & F.col("doc_id").isNotNull()).select("doc_id", "text_class").distinct()
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "text_class").limit(most)
    rows = sorted((r["doc_id"], r["text_class"], r["x"]) for r in stats.join(seen, "doc_id").select("doc_id", "x", "text_class").collect())
    return np.array([r[2] for r in rows]).reshape(-1, len(STATS)), np.array([CLASSES.index(r[1]) for r in rows], int)


def seeds(z: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres by k-means++ and ten rounds of k-means, and each row's centre."""
    centres = [z[rng.integers(len(z))]]
    near = ((z - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.sum() > 0:
        centres.append(z[rng.choice(len(z), p=near / near.sum())])
        near = np.minimum(near, ((z - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(10):
        own = ((z * z).sum(1)[:, None] - 2 * z @ c.T + (c * c).sum(1)).argmin(1)
        c = np.array([z[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c, own


def fit(stats: DataFrame, x: np.ndarray, y: np.ndarray, components: int = 12, rounds: int = 20, sample: int = 20_000, seed: int = 7) -> Mixture | None:
    """Expectation-maximisation over all rows of ``stats``; None for an empty table.

    Means and scales come from all rows. Starting centres are found among the inspected examples
    ``x`` of each class in ``y``, at most ``components`` a class and one for four examples, so that
    rare kinds of text get their own; without examples, among the ``sample`` rows with the smallest
    hash of ``doc_id``. Each round is one pass: every partition returns its sums of responsibility,
    statistics and products, ``1 + d + d (d + 1) / 2`` numbers a component; eight tasks add them up and the driver
    adds their eight rows. Nothing that grows with the table reaches it.
    """
    d = len(STATS)
    m = stats.select(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)), F.count("*").alias("n")).first()
    n = m["n"]
    if not n:
        return None
    mean, scale = np.array([m[f"m{i}"] for i in range(d)]), np.maximum([m[f"s{i}"] for i in range(d)], 1e-3)
    rng = np.random.default_rng(seed)
    if not len(x):
        x = np.array([r["x"] for r in stats.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select("x").collect()])
        y = np.zeros(len(x), int)
        components *= len(CLASSES)
    z = np.clip((x - mean) / scale, -12, 12)
    c, own = np.zeros((0, d)), np.zeros(len(z), int)
    for j in np.unique(y):
        at = np.flatnonzero(y == j)
        cj, ownj = seeds(z[at], max(1, min(components, len(at) // 4)), rng)
        own[at] = ownj + len(c)
        c = np.concatenate([c, cj])
    share = np.bincount(own, minlength=len(c)) + 1.0
    cov = np.array([np.cov(z[own == k].T, bias=True) + 0.05 * np.eye(d) if (own == k).sum() > 1 else 0.1 * np.eye(d) for k in range(len(c))])
    model = Mixture(mean, scale, share / share.sum(), c, cov)
    last = -np.inf
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total, ll = np.zeros((len(model.weights), model.linear.shape[0])), 0.0
            for b in batches:
                x = expanded(model.standard(_rows(b)))
                p, like = model.shared(x)
                total += p.T @ x
                ll += like.sum()
            v = np.append(total.ravel(), ll)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], ["v"])

        parts = stats.select("x").mapInArrow(sums, "v array<double>").repartition(8).mapInArrow(added, "v array<double>").collect()
        v = np.sum([np.array(x["v"]) for x in parts], axis=0)
        total = v[:-1].reshape(len(model.weights), -1)
        r, s, q = total[:, 0], total[:, 1 : 1 + d], np.zeros((len(total), d, d))
        i, j = np.triu_indices(d)
        q[:, i, j] = q[:, j, i] = total[:, 1 + d :]
        r = np.maximum(r, 1e-6)
        c = s / r[:, None]
        cov = q / r[:, None, None] - c[:, :, None] * c[:, None, :]
        # A wide prior keeps a component of few rows from collapsing.
        cov = (cov * r[:, None, None] + 5 * 0.1 * np.eye(d)) / (r[:, None, None] + 5)
        model.set(r / r.sum(), c, cov)
        if v[-1] - last < 1e-4 * n:
            break
        last = v[-1]
    return model


def name_components(model: Mixture, x: np.ndarray, y: np.ndarray) -> Mixture:
    """Gives each component the classes of the inspected examples that fall to it; one without examples takes those of the nearest one that has some."""
    if not len(x):
        return model
    p, _ = model.posterior(model.standard(x))
    votes = np.stack([p[y == j].sum(0) for j in range(len(CLASSES))], axis=1)
    total = votes.sum(1)
    known = np.flatnonzero(total >= min(0.5, total.max()))
    for k in range(len(total)):
        j = k if k in known else min(known, key=lambda i: float(((model.centres[i] - model.centres[k]) ** 2).sum()))
        model.classes[k] = votes[j] / votes[j].sum()
    return model


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text_class, chance, component)`` of every document whose text isn't null or blank.

    Texts are measured once. Repeated rows count once. Without labels every class is equally likely
    and the first is reported. An empty table gives an empty result.
    """
    stats = staged(measured(documents))
    x, y = examples(stats, labels)
    model = fit(stats, x, y)
    schema = "doc_id long, text_class string, chance double, component int"
    if model is None:
        return stats.sparkSession.createDataFrame([], schema)
    model = name_components(model, x, y)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _ = model.posterior(model.standard(_rows(b)))
            c = p @ model.classes
            names = pa.array([CLASSES[i] for i in c.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names, pa.array(c.max(1).round(6)), pa.array(p.argmax(1).astype(np.int32))], ["doc_id", "text_class", "chance", "component"])

    return stats.mapInArrow(classify, schema)
