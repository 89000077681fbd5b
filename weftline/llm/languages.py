"""Problem 2: languages of documents and of their segments, by multilingual mixture inference.

Every language has an n-gram model of words (character trigrams for unknown words). A document is a mixture: each segment
comes from one language, expectation-maximisation estimates the proportions from the segments' likelihoods, and the set of
languages is chosen by penalised likelihood: a language joins only if it explains full sentences so much better than the
languages already there that the gain exceeds the penalty. Code, log lines, identifiers and addresses are cut out first.
The languages are those that enough rows are labelled with; a text that none of them accounts for has none of them.

The models are fitted on a bounded sample of labelled rows (SAMPLE texts, those with the smallest hashes); since labels are
partly wrong, the sample is relabelled by the first fit and fitted again. Every document is classified, and whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_LANGUAGE = ("mis", "mul", "und", "zxx")  # fixed values: the codes of ISO 639-2 for uncoded, several, undetermined and no language
MIN_LABELLED = 0.005  # share of the labelled rows that makes a code a language of the corpus; at most 200 codes have it
OWN_WORDS = 0.18  # share of a text's words that its languages must own; less is another language
SAMPLE = 15_000  # labelled texts that the models are fitted on
MIN_LETTERS = 40
PENALTY = 14.0  # nats that a further language must gain beyond log(number of words)
SENTENCE_WORDS = 4  # words of a language's own vocabulary that make a segment a full sentence
MARGIN = 1.5  # nats a word by which a segment must prefer a further language
ROUNDS = 12
MEMO = 200_000  # words outside the vocabulary that a worker remembers

_NOISE = re.compile(
    r"```.*?(?:```|\Z)|`[^`\n]*`|\{[^{}\n]*\}?|^[>\s\-*]*\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d[^\n]*|(?<!\S)[^\s\d_/#@\\=<>`{]*[\d_/#@\\=<>]\S*|\[[^\]\n]*\]", re.S | re.M
)
_CUT = re.compile(r"[.!?…:;]+[)»”\"']*(?:\s+|$)|\n+|[«»“”\"]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches between sentence ends, line breaks and quotation marks of the text as it is."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _blank(m: re.Match) -> str:
    # keep lengths, line breaks and a sentence end that hangs on an identifier
    s = m.group()
    tail = re.search(r"[.!?…:;,)»”\"]*$", s).group() if not s.startswith(("```", "`")) else ""
    return "".join(c if c == "\n" else " " for c in s[: len(s) - len(tail)]) + tail


# full-width forms and their blank have narrow twins of the same length
_NARROW = {0x3000: 0x20} | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


def prepared(text: str) -> str:
    return _NOISE.sub(_blank, text if text.isascii() else text.translate(_NARROW))


class Model:
    """Word unigrams with a character-trigram fallback for each language."""

    def __init__(self, languages: tuple[str, ...], counts: list[Counter]):
        self.languages = languages
        n = len(languages)
        total = [sum(c.values()) + 1 for c in counts]
        vocabulary = sorted({w for c in counts for w, k in c.items() if k >= 3})
        grams: list[Counter] = []
        for c in counts:
            g: Counter = Counter()
            for w, k in c.items():
                for x in self._grams(w):
                    g[x] += k
            grams.append(g)
        gram_total = [sum(g.values()) + 1 for g in grams]
        kinds = len(set().union(*grams)) + 1
        self.trigrams = {x: np.log([(g[x] + 0.1) / (t + 0.1 * kinds) for g, t in zip(grams, gram_total)]) for x in set().union(*grams)}
        self.floor = np.log([0.1 / (t + 0.1 * kinds) for t in gram_total])
        self.words = {}
        for w in vocabulary:
            p = np.array([c[w] / t for c, t in zip(counts, total)])
            back = np.exp(self._spelled(w) / max(1, len(w)) * 3)
            p = 0.98 * p + 0.02 * back / len(vocabulary)
            own = p / p.sum()
            # a word is a language's own if it occurs there and hardly elsewhere
            self.words[w] = (np.log(p), own >= 0.75)
        self.known = len(self.words)
        self.row = {w: i for i, w in enumerate(self.words)}
        self.likes = [x for x, _ in self.words.values()]
        self.owns = [x for _, x in self.words.values()]
        self.none = np.zeros(n, dtype=bool)
        del self.words

    @staticmethod
    def _grams(w: str) -> list[str]:
        w = f"^{w}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _spelled(self, w: str) -> np.ndarray:
        return sum((self.trigrams.get(x, self.floor) for x in self._grams(w)), np.zeros(len(self.languages)))

    def add(self, w: str) -> int:
        """Row of a word outside the vocabulary: its spelling, bounded to a few nats between languages."""
        x = self._spelled(w)
        self.row[w] = k = len(self.likes)
        self.likes.append(np.maximum(x, x.max() - 4.0))
        self.owns.append(self.none)
        return k

    def trim(self) -> None:
        """Forget words outside the vocabulary when there are many."""
        if len(self.likes) > self.known + MEMO:
            self.likes, self.owns = self.likes[: self.known], self.owns[: self.known]
            self.row = {w: k for w, k in self.row.items() if k < self.known}


def fit(samples: list[tuple[str, str]], languages: tuple[str, ...] | None = None) -> Model:
    """Fit on (text, language) in the given languages or all that occur, relabel the texts by that fit and fit again; texts found mixed are left out of the second fit."""
    languages = tuple(sorted({x for _, x in samples})) if languages is None else languages
    index = {x: i for i, x in enumerate(languages)}
    split = [(_WORD.findall(prepared(t).lower()), index[x]) for t, x in samples if x in index]

    def counted(rows: list[tuple[list[str], int]]) -> list[Counter]:
        c = [Counter() for _ in languages]
        for ws, i in rows:
            c[i].update(ws)
        return c

    first = Model(languages, counted(split))
    texts = [t for t, x in samples if x in index]
    found = infer(texts, first)
    again = [(ws, index[f["language"]]) for (ws, _), f in zip(split, found) if f["language"] in index]
    return Model(languages, counted(again)) if again else first


def infer(texts: list[str], model: Model) -> list[dict]:
    """For each text: language (a code, 'mixed', or None without evidence), confidence, proportions, and segments (start, end, language, confidence)."""
    n_lang = len(model.languages)
    if not n_lang:
        return [{"language": None, "confidence": 0.0, "proportions": {}, "segments": []} for _ in texts]
    model.trim()
    get, add = model.row.get, model.add
    doc_of, spans, ids, n_words = [], [], [], []
    for d, text in enumerate(texts):
        clean = prepared(text)
        low = clean.lower()
        if len(low) != len(clean):  # a few letters change their length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in clean)
        for a, b in segments(clean):
            ws = _WORD.findall(low, a, b)
            if ws:
                ids += [add(w) if (k := get(w)) is None else k for w in ws]
                doc_of.append(d)
                spans.append((a, b))
                n_words.append(len(ws))
    out = [{"language": None, "confidence": 0.0, "proportions": {}, "segments": []} for _ in texts]
    if not doc_of:
        return out
    doc, size = np.array(doc_of), np.array(n_words)
    used, at = np.unique(np.array(ids), return_inverse=True)
    first = np.r_[0, np.cumsum(size)[:-1]]
    ll = np.add.reduceat(np.stack([model.likes[k] for k in used])[at], first)
    mine = np.add.reduceat(np.stack([model.owns[k] for k in used]).astype(np.int32)[at], first)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
    words_in = np.add.reduceat(size, starts)
    # segments of too few own words say nothing about the language set: names, addresses, labels
    full = mine >= SENTENCE_WORDS
    evidence = np.where((mine.max(axis=1) >= 1)[:, None], ll, 0.0)
    total = np.add.reduceat(evidence, starts)
    some = np.add.reduceat(mine, starts)
    chosen = np.zeros((len(starts), n_lang), dtype=bool)
    rank = np.where(some > 0, total, -np.inf)
    best = rank.argmax(axis=1)
    has = some.max(axis=1) > 0
    chosen[np.arange(len(starts)), best] = has
    for _ in range(n_lang - 1):
        have = np.where(chosen[row], ll, -np.inf).max(axis=1)
        gain = ll - have[:, None]
        counts = full & (gain > MARGIN * np.minimum(size, 12)[:, None])
        gain = np.add.reduceat(np.where(counts, gain, 0.0), starts)
        gain[chosen] = 0.0
        top = gain.argmax(axis=1)
        add = has & (gain[np.arange(len(starts)), top] > PENALTY + np.log(words_in))
        if not add.any():
            break
        chosen[np.flatnonzero(add), top[add]] = True
    # a first language that explains no full sentence once others are in leaves again
    have = np.where(chosen[row], ll, -np.inf)
    lead = have.argmax(axis=1)
    holds = np.zeros((len(starts), n_lang), dtype=bool)
    ok = full[np.arange(len(row)), lead] & has[row]
    np.logical_or.at(holds, (row[ok], lead[ok]), True)
    several = chosen.sum(axis=1) > 1
    keep = chosen & holds
    chosen = np.where((several & keep.any(axis=1))[:, None], keep, chosen)
    # a text whose words mostly belong to none of its languages is in another one
    # (a word belongs to one language at most)
    has &= np.add.reduceat((mine * chosen[row]).sum(axis=1), starts) >= OWN_WORDS * words_in
    # expectation-maximisation of the proportions over the chosen set
    pi = chosen / np.maximum(1, chosen.sum(axis=1))[:, None]
    weight = size / words_in[row]
    top = np.where(chosen[row], ll, -np.inf).max(axis=1)
    like = np.where(chosen[row], np.exp(np.clip(ll - np.where(np.isfinite(top), top, 0.0)[:, None], -60, 0)), 0.0)
    for _ in range(ROUNDS):
        r = like * pi[row]
        r /= np.maximum(r.sum(axis=1), 1e-300)[:, None]
        pi = np.add.reduceat(r * weight[:, None], starts)
    r = like * pi[row]
    r /= np.maximum(r.sum(axis=1), 1e-300)[:, None]
    # confidence: posterior of the chosen language against all, damped for few own words
    free = np.exp(np.clip(ll - ll.max(axis=1)[:, None], -60, 0))
    post = free / free.sum(axis=1)[:, None]
    for k, s in enumerate(starts):
        d, e = doc[s], starts[k + 1] if k + 1 < len(starts) else len(doc)
        if not has[k]:
            continue
        names = np.flatnonzero(chosen[k])
        o = out[d]
        o["language"] = model.languages[names[0]] if len(names) == 1 else "mixed"
        o["proportions"] = {model.languages[i]: round(float(pi[k, i]), 4) for i in names}
        strength = 1.0 - 0.5 ** max(1, int(some[k][names].max()))
        o["confidence"] = round(float((post[s:e][:, names].sum(axis=1) * weight[s:e]).sum() * strength), 4)
        for i in range(s, e):
            j = int(r[i].argmax())
            o["segments"].append((*spans[i], model.languages[j], round(float(r[i, j] * (1.0 - 0.5 ** max(1, int(mine[i, j])))), 4)))
    return out


def _code() -> Column:
    return F.lower(F.trim(F.substring_index("language", "-", 1)))


def labelled_languages(df: DataFrame, least: float = MIN_LABELLED) -> tuple[str, ...]:
    """Codes of two or three letters that at least that share of the rows with such a code carry."""
    n = df.select(_code().alias("code")).filter(F.col("code").rlike("^[a-z]{2,3}$") & ~F.col("code").isin(*NO_LANGUAGE)).groupBy("code").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return tuple(sorted(r["code"] for r in n.filter(F.col("n") >= max(1.0, least * total)).collect()))  # 1 / least codes at most


def training_sample(df: DataFrame, languages: tuple[str, ...], sample: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `sample` (text, language) of rows whose label names one of the languages: those with the smallest text hashes, whatever the partitioning.

    A hash bound that leaves about twice the sample is applied before the ordered limit, so no partition sends its own
    `sample` rows to the driver.
    """
    if not languages:
        return []
    code = _code()
    d = df.filter(code.isin(*languages) & (letters("text") >= MIN_LETTERS)).select(F.xxhash64("text").alias("h"), "text", code.alias("code"))
    n = d.count()
    bound = -(2**63) + min(2**64 - 1, 2**64 * 2 * sample // max(n, 1))
    d = d.filter(F.col("h") <= F.lit(bound))
    return [(r["text"], r["code"]) for r in d.orderBy("h", "text", "code").limit(sample).select("text", "code").collect()]


def letters(c: str):
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def identify(df: DataFrame, keys: list[str], languages: tuple[str, ...] | None = None, sample: int = SAMPLE, model: Model | None = None, min_letters: int = 0) -> DataFrame:
    """keys, language (as labelled), found, confidence, proportions, segments of every row with a text of at least min_letters letters.

    Rows with a null text are left out. found is a code, 'mixed', or null where a text has no words of any language (only
    code or identifiers) or is in none of the languages, which are those of labelled_languages() if not given. Confidence
    falls with the number of words that speak for a language, so short texts have a low one. Segments are (start, end,
    language, confidence) offsets of the text. Repeated rows are classified once each distinct (keys, language, text).
    Without labelled rows all are null.
    """
    spark = df.sparkSession
    d = df.select(*keys, "language", "text").filter("text IS NOT NULL")
    if min_letters:
        d = d.filter(letters("text") >= min_letters)
    if model is None:
        languages = labelled_languages(df) if languages is None else languages
        model = fit(training_sample(df, languages, sample), languages)
    held = spark.sparkContext.broadcast(model)  # at most `sample` texts' words

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = infer(f["text"].tolist(), held.value)
            f = f.drop(columns="text")
            f["found"] = [x["language"] for x in found]
            f["confidence"] = [x["confidence"] for x in found]
            f["proportions"] = [x["proportions"] for x in found]
            f["segments"] = [[dict(zip(("start", "end", "language", "confidence"), s)) for s in x["segments"]] for x in found]
            yield f

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", language string, found string, confidence double, proportions map<string,double>, segments array<struct<start:int,end:int,language:string,confidence:double>>"
    )
    return d.mapInPandas(run, schema)


def wrong_labels(found: DataFrame) -> DataFrame:
    """Rows whose label is null, empty or doesn't name the language found (only the part before a hyphen counts, case ignored)."""
    code = F.lower(F.trim(F.substring_index(F.coalesce("language", F.lit("")), "-", 1)))
    return found.filter(F.col("found").isNotNull() & (code != F.col("found")))
