"""Problem 8: passages of evaluation items inside documents.

A generalised suffix automaton of the items' normalised words is streamed over the words of each document, tracking the
longest match that ends at each word. Where it reaches the limit, the state that holds the last `limit` words names all
items with that passage. Items go into automata of bounded size; every automaton scans all documents.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
SHARD_WORDS = 500_000  # words of one automaton; about 300 MB on a worker
_DROP = dict.fromkeys([0x00AD, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after dropping soft hyphens and zero-width characters, NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(_DROP)).lower())


class Automaton:
    """Suffix automaton of several word sequences; `holds[state]` names the items whose passage of min_words the state's ancestor stands for."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        for n, (item, seq) in enumerate(items):
            last = 0
            for w in [*(self.ids.setdefault(x, len(self.ids)) for x in seq), -1 - n]:  # a separator of its own ends each item
                last = self._extend(last, w)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add(item)
            ends[last].discard(item)
        self.holds: list[tuple[int, ...] | None] = [None] * len(self.next)
        order = sorted(range(1, len(self.next)), key=lambda v: -self.length[v])
        for v in order:
            if self.length[v] >= min_words and self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        for v in reversed(order):  # from short to long: the state itself or its link's
            if self.length[v] >= min_words:
                up = self.link[v]
                self.holds[v] = self.holds[up] if self.length[up] >= min_words else tuple(sorted(ends[v]))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        return cur

    def scan(self, seq: list[str]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(position of the last word, longest match, items) wherever the match has min_words or more."""
        nxt, link, length, least, holds = self.next, self.link, self.length, self.min_words, self.holds
        out, v, n = [], 0, 0
        get = self.ids.get
        for i, x in enumerate(seq):
            w = get(x)
            if w is None:
                v = n = 0
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(w)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= least:
                u = v
                while length[link[u]] >= n:  # the match may be shorter than the state
                    u = link[u]
                out.append((i, n, holds[u]))
        return out


_built: dict[str, Automaton] = {}


def _automaton(mark: str, items: list[tuple[int, str]], min_words: int) -> Automaton:
    if mark not in _built:
        while len(_built) > 1:  # two automata in a worker's memory at a time
            del _built[next(iter(_built))]
        _built[mark] = Automaton([(i, words(t)) for i, t in items], min_words)
    return _built[mark]


def _shards(items: DataFrame, shard_words: int) -> list[list[tuple[int, str]]]:
    """Items in shards of about shard_words words, streamed to the driver shard by shard; items without min_words words are left to the caller."""
    shards, now, size = [], [], 0
    for r in items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"]) // 4 + 1
        if now and size + n > shard_words:
            shards.append(now)
            now, size = [], 0
        now.append((r["item_id"], r["text"]))
        size += n
    return [*shards, now] if now else shards


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, longest_words, covered_words, item_words): documents with at least min_words consecutive words of an item.

    covered_words are the document's words inside matches with the item. Null or blank texts match nothing; an item's
    repeated rows count as one item. Empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, longest_words int, covered_words int"
    out = None
    base = docs.filter("text IS NOT NULL").select("doc_id", "text")
    for shard in _shards(items, shard_words):
        held, mark = spark.sparkContext.broadcast(shard), uuid.uuid4().hex

        def scan(frames: Iterator[pd.DataFrame], held=held, mark=mark) -> Iterator[pd.DataFrame]:
            a = _automaton(mark, held.value, min_words)
            for f in frames:
                rows = []
                for doc, text in zip(f["doc_id"], f["text"]):
                    best: dict[int, list[int]] = {}
                    for i, n, found in a.scan(words(text)):
                        for item in found:
                            # of a longer match only the last min_words are sure to be this item's
                            b = best.setdefault(item, [0, 0, -1, 0])
                            b[3] = b[3] + 1 if b[2] == i - 1 else min_words
                            b[1] += 1 if b[2] == i - 1 else min(min_words, i - b[2])
                            b[0], b[2] = max(b[0], b[3]), i
                    rows += [(doc, item, b[0], b[1]) for item, b in best.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_words", "covered_words"])

        part = base.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    if docs.isEmpty():
        return spark.createDataFrame([], schema)
    return out


def clean(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_cover: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, action, removed_words, text): kept as it is, spans_removed, or dropped (text null) if matches cover more than max_cover of the words.

    Spans go by whole blank-separated chunks; the remaining text keeps its own white space. Null texts are kept. Every shard
    of items scans all documents in a pass of its own and reports spans; the spans of all shards meet at the document.
    """
    spark = docs.sparkSession
    base = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("h"), "text")
    spans = None
    for shard in _shards(items, shard_words):
        held, mark = spark.sparkContext.broadcast(shard), uuid.uuid4().hex

        def scan(frames: Iterator[pd.DataFrame], held=held, mark=mark) -> Iterator[pd.DataFrame]:
            a = _automaton(mark, held.value, min_words)
            for f in frames:
                rows = []
                for h, text in zip(f["h"], f["text"]):
                    first = last = -1
                    for i, n, _ in a.scan(words(text)):
                        if first >= 0 and i - n + 1 <= last + 1:
                            first, last = min(first, i - n + 1), i
                            continue
                        if first >= 0:
                            rows.append((h, text, first, last))
                        first, last = i - n + 1, i
                    if first >= 0:
                        rows.append((h, text, first, last))
                yield pd.DataFrame(rows, columns=["h", "text", "first", "last"])

        part = base.mapInPandas(scan, "h long, text string, first int, last int")
        spans = part if spans is None else spans.unionByName(part)
    if spans is None:
        spans = spark.createDataFrame([], "h long, text string, first int, last int")
    found = spans.groupBy("h", "text").agg(F.collect_set(F.struct("first", "last")).alias("spans"))  # spans of one text

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, t, own in zip(f["doc_id"], f["text"], f["spans"]):
                if own is None or not len(own):
                    rows.append((doc, "kept", 0, t))
                    continue
                hit = bytearray(len(words(t)))
                for s in own:
                    hit[s["first"] : s["last"] + 1] = b"\1" * (s["last"] + 1 - s["first"])
                n = sum(hit)
                if n > max_cover * len(hit):
                    rows.append((doc, "dropped", n, None))
                    continue
                out, at = [], 0
                for chunk in re.split(r"(\s+)", t):
                    k = len(words(chunk))
                    if not (k and any(hit[at : at + k])):
                        out.append(chunk)
                    at += k
                rows.append((doc, "spans_removed", n, "".join(out)))
            yield pd.DataFrame(rows, columns=["doc_id", "action", "removed_words", "text"])

    own = found.withColumnsRenamed({"h": "__h", "text": "__t"})
    d = docs.select("doc_id", "text").join(own, (F.xxhash64("text") == F.col("__h")) & (F.col("text") == F.col("__t")), "left").select("doc_id", "text", "spans")
    return d.mapInPandas(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, action string, removed_words int, text string")
