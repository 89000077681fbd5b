"""Text features and linear heads: n-gram weights, vectors, masked heads, temperature."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.classification import softmax
from weftline.session import materialize

ROOM = 1_000_000  # characters whose grams a worker counts at once, or those of one row
ROWS = 100_000  # weights of one Arrow batch


def _beside(a: Column, b: Column, skip: int, sep: str) -> Column:
    """Element i of a joined with element i + skip of b. Both arrays are made once for a row, not once for each element."""
    n = F.greatest(F.size(b) - skip, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), lambda x, y: F.concat(x, F.lit(sep), y) if sep else F.concat(x, y))


def char_ngrams(text: Column, lo: int = 3, hi: int = 5) -> Column:
    """All character n-grams of a text, with repeats; time grows with the length of the text, as no substring is looked up."""
    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    grams, out = chars, []
    for n in range(1, hi + 1):
        grams = grams if n == 1 else _beside(grams, chars, n - 1, "")
        if n >= lo:
            out.append(grams)
    return F.flatten(F.array(*out))


def word_ngrams(text: Column) -> Column:
    """Words of two or more word characters in lower case, and pairs of neighbours."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.concat(w, _beside(w, w, 1, " "))


def tfidf(df: DataFrame, key: str, grams: Column, min_df: int = 2, cap: int = 40_000) -> DataFrame:
    """(key, term, weight): sublinear term frequency times smooth idf plus one, each row's weights of length 1.

    Terms in fewer than min_df rows are dropped; of the others the `cap` most frequent by total count stay (ties by term).
    Rows with a null key or text have no weights.
    """
    tf = df.filter(F.col(key).isNotNull()).select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).filter(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(cap)
    total = df.filter(F.col(key).isNotNull()).select(key).distinct().agg(F.count("*").alias("__n"))
    idf = stats.crossJoin(F.broadcast(total)).select("term", (F.ln((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    w = tf.join(idf, "term").select(key, "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def rounded(number: str, digits: int) -> Column:
    """round() of a double between -1 and 1 without a decimal number for each; values close to a tie still go through it. digits: 8 at most."""
    y = F.col(number) * 10.0**digits
    return F.when(F.abs(y - F.floor(y) - 0.5) < 1e-4, F.round(number, digits)).otherwise(F.rint(y) / 10.0**digits)


def gram_counts(docs: list[list[str]], lo: int, hi: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, holders, doc, tf): character lo- to hi-grams of lists of texts, counted by list; holders[i] rows of (doc, tf) in a row belong to gram i.

    A gram is one number, digits of the characters that occur, with the list's number behind it; sorting these numbers
    counts them. Lists that need more than 64 bits together are counted in halves, a single one by its strings.
    """
    texts = [t for d in docs for t in d]
    if not texts:
        return
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rank = np.zeros(0x110000, dtype=np.uint64)
    rank[codes] = 1
    alphabet = np.flatnonzero(rank).astype(np.uint32)
    rank[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)  # no digit is 0, so grams of all lengths differ
    bits, shift = len(alphabet).bit_length(), (len(docs) - 1).bit_length()
    if hi * bits + shift > 64:
        if len(docs) > 1:
            for half in (range(len(docs) // 2), range(len(docs) // 2, len(docs))):
                for grams, holders, doc, tf in gram_counts([docs[i] for i in half], lo, hi):
                    yield grams, holders, doc + half.start, tf
            return
        n = Counter(t[i : i + k] for t in texts for k in range(lo, hi + 1) for i in range(len(t) - k + 1))
        yield list(n), np.ones(len(n), np.int64), np.zeros(len(n), np.int64), np.fromiter(n.values(), np.int64, len(n))
        return
    lengths = [len(t) for t in texts]
    segment = np.repeat(np.arange(len(texts)), lengths)
    owner = np.repeat(np.repeat(np.arange(len(docs), dtype=np.uint64), [len(d) for d in docs]), lengths)
    digits = rank[codes]
    gram, keys = digits, []
    for k in range(2, hi + 1):
        gram = (gram[:-1] << np.uint64(bits)) | digits[k - 1 :]
        if k >= lo and len(gram):
            inside = segment[: len(gram)] == segment[k - 1 :]
            keys.append(((gram << np.uint64(shift)) | owner[: len(gram)])[inside])
    if lo == 1:
        keys.append((digits << np.uint64(shift)) | owner)
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if not len(key):
        return
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf, key = np.diff(first, append=len(key)), key[first]
    gram, doc = key >> np.uint64(shift), (key & np.uint64((1 << shift) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    holders, gram = np.diff(first, append=len(gram)), gram[first]
    grams: list[str] = []
    edges = np.searchsorted(gram, np.array([1 << (bits * (k - 1)) for k in range(lo, hi + 1)], dtype=np.uint64)).tolist()
    for k, a, b in zip(range(lo, hi + 1), edges, [*edges[1:], len(gram)]):
        places = np.arange(k - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
        letters = alphabet[((gram[a:b, None] >> places) & np.uint64((1 << bits) - 1)).astype(np.int64) - 1]
        text = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        grams += [text[i : i + k] for i in range(0, len(text), k)]
    yield grams, holders, doc, tf


def _in_room(docs: list[list[str]]) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of about ROOM characters."""
    begin = held = 0
    for i, d in enumerate(docs):
        held += sum(map(len, d))
        if held >= ROOM or i + 1 == len(docs):
            yield begin, i + 1
            begin, held = i + 1, 0


def char_tfidf(df: DataFrame, key: str, text: str, lo: int = 3, hi: int = 5, min_df: int = 2, cap: int = 40_000) -> DataFrame:
    """(key, term, weight): tfidf() of the character lo- to hi-grams of a text column; repeated rows count once.

    The grams of all texts are a thousand times as many as the texts, so they are counted where the texts are, twice: first
    for the terms and their frequencies, then for the weights. Only counts by gram and task are shuffled, and the texts once
    by key. The terms, `cap` at most, are sent to the workers.
    """
    import pyarrow as pa

    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(text).alias("__texts"))
    rows, _ = materialize(rows, "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for a, b in _in_room(docs):
                for grams, holders, _, tf in gram_counts(docs[a:b], lo, hi):
                    n = np.add.reduceat(tf, np.cumsum(holders) - holders)
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(holders, pa.int64()), pa.array(n, pa.int64())], ["term", "df", "n"])

    stats = rows.select("__texts").mapInArrow(count, "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    # written first: a direct collect would send the best rows of every partition to the driver
    stats, _ = materialize(stats.filter(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(cap).select("term", "df"), "terms")
    stats = stats.toPandas()  # at most `cap` rows
    idf = np.log((1 + rows.count()) / (1 + stats["df"].to_numpy(dtype=np.float64))) + 1
    known = spark.sparkContext.broadcast((stats["term"].tolist(), idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = known.value
        at, names = {t: i for i, t in enumerate(terms)}, pa.array(terms, pa.string())
        for batch in batches:
            keys, docs = batch.column(0), batch.column(1).to_pylist()
            for a, b in _in_room(docs):
                found = []
                for grams, holders, doc, tf in gram_counts(docs[a:b], lo, hi):
                    term = np.repeat(np.fromiter((at.get(g, -1) for g in grams), np.int64, len(grams)), holders)
                    keep = term >= 0
                    found.append((doc[keep], term[keep], (1 + np.log(tf[keep])) * idf[term[keep]]))
                if found:
                    doc, term, w = (np.concatenate(x) for x in zip(*found))
                    w /= np.sqrt(np.bincount(doc, w * w, minlength=b - a))[doc]
                    for i in range(0, len(w), ROWS):
                        j = slice(i, i + ROWS)
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[j] + a)), names.take(pa.array(term[j])), pa.array(w[j])], [key, "term", "weight"])

    return rows.select(key, "__texts").mapInArrow(weigh, f"`{key}` {kind}, term string, weight double")


def tfidf_blocks(df: DataFrame, key: str, blocks: dict[str, tuple[Column, int]], min_df: int = 2) -> DataFrame:
    """(block, key, term, weight): tfidf() of several kinds of terms side by side; blocks: name to (terms, cap). Each block has length 1, the whole row isn't normalised again."""
    out = None
    for name, (grams, cap) in blocks.items():
        b = tfidf(df, key, grams, min_df, cap).select(F.lit(name).alias("block"), key, "term", "weight")
        out = b if out is None else out.unionByName(b)
    return out


def tokenized_windows(df: DataFrame, key: str, text: str, tokenize: Callable[[str], Sequence], length: int, stride: int | None = None, prefix: str = "") -> DataFrame:
    """(key, window_no, tokens, weight): windows of at most `length` tokens of prefix + text, no token lost; weight counts the tokens that a window is first to cover.

    tokenize is called once for each text on the workers and may return ids or strings; the prefix's tokens open every
    window and have no weight. Null texts have no window.
    """
    step = stride or length

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = [str(t) for t in tokenize(prefix)] if prefix else []
        room, hop = length - len(head), min(step, length - len(head))
        if room < 1:
            raise ValueError("the prefix leaves no room")
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text]):
                ts = [] if t is None else [str(x) for x in tokenize(t)]
                end = at = n = 0
                while end < len(ts) or (not n and t is not None):
                    stop = min(at + room, len(ts))
                    rows.append((k, n, head + ts[at:stop], stop - end))
                    end, at, n = stop, at + hop, n + 1
            yield pd.DataFrame(rows, columns=[key, "window_no", "tokens", "weight"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, window_no int, tokens array<string>, weight int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def linear_logits(v: Column, coef: list[list[float]], intercept: list[float]) -> Column:
    """One logit for each class: coefficients times v plus intercept."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) + float(b) for row, b in zip(coef, intercept)])


def pooled(df: DataFrame, owner: list[str], vector: str, weight: str) -> DataFrame:
    """(owner, vector): weighted sum of unit vectors of an owner's windows, at length 1."""
    x = df.select(*owner, F.col(weight).alias("__w"), F.posexplode(normalized(F.col(vector))).alias("i", "x"))
    s = x.groupBy(*owner, "i").agg(F.sum(F.col("x") * F.col("__w")).alias("x"))
    v = s.groupBy(*owner).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select(*owner, F.transform("a", lambda e: e.x).alias("__v"))  # one vector
    return v.select(*owner, normalized(F.col("__v")).alias("vector"))


def aggregate_logits(df: DataFrame, by: list[str], cls: str, logit: str, mode: str = "max") -> DataFrame:
    """(by, cls, logit) over windows by max or mean, before any softmax; NaN logits are an error of the caller and excluded by assertion."""
    if mode not in ("max", "mean"):
        raise ValueError("mode is max or mean")
    return df.groupBy(*by, cls).agg((F.max if mode == "max" else F.avg)(F.when(F.isnan(logit), F.raise_error(F.lit("a logit is NaN"))).otherwise(F.col(logit))).alias("logit"))


@dataclass(frozen=True)
class Head:
    """Three-class linear head; classes without training rows get an intercept of -30."""

    coef: list[list[float]]
    intercept: list[float]
    classes: tuple[int, ...]

    def logits(self, v: Column) -> Column:
        return linear_logits(v, self.coef, self.intercept)

    def probabilities(self, v: Column, temperature: float = 1.0) -> Column:
        return softmax(self.logits(v), temperature)


def fit_head(df: DataFrame, vector: str, label: str, c: float = 1.0, n_classes: int = 3, balanced: bool = False) -> Head:
    """Multinomial ridge-penalised logistic head with the objective c * sum of losses + |B|**2 / 2, fitted by Spark ML.

    Rows with a null or negative label are masked. One observed class gives a constant head, two give symmetric logits.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = df.filter(F.col(label) >= 0).select(F.transform(vector, lambda x: x.cast("double")).alias("v"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in d.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("no labelled rows")
    seen = sorted(counts)
    dim = len(d.select("v").first()["v"])
    coef, intercept = [[0.0] * dim for _ in range(n_classes)], [-30.0] * n_classes
    if len(seen) == 1:
        intercept[seen[0]] = 0.0
        return Head(coef, intercept, tuple(seen))
    total = sum(counts.values())
    weight = {k: total / (len(seen) * n) if balanced else 1.0 for k, n in counts.items()}
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in weight.items() for x in (k, v)]), F.col("y"))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(seen) for x in (k, float(i))]), F.col("y"))
    t = d.select(array_to_vector("v").alias("features"), rank.alias("label"), w.alias("weight"))
    lr = LogisticRegression(family="multinomial" if len(seen) > 2 else "binomial", regParam=1 / (c * sum(weight[k] * n for k, n in counts.items())), standardization=False, weightCol="weight", maxIter=300, tol=1e-9)
    m = lr.fit(t)
    if len(seen) == 2:
        b, b0 = m.coefficients.toArray() / 2, m.intercept / 2
        coef[seen[0]], coef[seen[1]], intercept[seen[0]], intercept[seen[1]] = (-b).tolist(), b.tolist(), -b0, b0
    else:
        for i, k in enumerate(seen):
            coef[k], intercept[k] = m.coefficientMatrix.toArray()[i].tolist(), float(m.interceptVector[i])
    return Head(coef, intercept, tuple(seen))


def fit_temperature(df: DataFrame, logits: str, label: str, low: float = 0.25, high: float = 4.0, grid: int = 16, rounds: int = 4) -> float:
    """Temperature in [low, high] with the lowest log loss, 1 if none is better; each round is one aggregate over a refined grid."""

    def losses(ts: list[float]) -> list[float]:
        p = [F.avg(-F.ln(F.greatest(F.element_at(softmax(F.col(logits), t), F.col(label).cast("int") + 1), F.lit(1e-12)))) for t in ts]
        return list(df.filter(F.col(label) >= 0).agg(*p).first())

    [at_one] = losses([1.0])
    if at_one is None:
        return 1.0
    best, best_loss, a, b = 1.0, at_one, low, high
    for _ in range(rounds):
        ts = np.exp(np.linspace(np.log(a), np.log(b), grid)).tolist()
        ls = losses(ts)
        i = int(np.argmin(ls))
        if ls[i] < best_loss - 1e-12:
            best, best_loss = ts[i], ls[i]
        a, b = ts[max(0, i - 1)], ts[min(grid - 1, i + 1)]
    return best


def token_windows(n_tokens: Column, length: int, stride: int | None = None) -> Column:
    """Array of (start, end, weight) windows over n_tokens tokens: no token is lost, weight is the number of tokens that a window is first to cover."""
    step = stride or length
    starts = F.when(n_tokens <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n_tokens - length + step - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + length, n_tokens).alias("end"), F.when(s == 0, F.least(F.lit(length), n_tokens)).otherwise(F.least(s + length, n_tokens) - (s - step + length)).alias("weight")))
