"""Problem 10: cutting oversized items at natural boundaries.

A worker writes every oversized text as a shadow string with one letter for each token: what kind of boundary follows that
token. On the shadow a bounded quantifier counts tokens, so one regular expression does the cutting: its alternatives, in
order of boundary strength, consume up to the limit, and the last one falls back to any character. Pieces overlap by
looking back a given number of tokens. Cutting, overlap and slicing are SQL array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import PATTERN, TOKENIZERS, VOCABULARY, encoding, over_limit

# letters of the shadow: paragraph, line, sentence, clause, word, character, inside a character
KINDS = "PLSCWcx"
ROOM = 250_000  # characters whose tokens a worker holds at once, or those of one text; a token takes about 100 bytes


def shadow(text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[str, list[int]]:
    """(letters, ends): the boundary letter after each token and the character offset at which each token ends.

    A token that ends inside a character has the letter x and the offset of that character's start; no cut is made there.
    """
    import regex

    enc = encoding(folder, vocabulary)
    letters: list[str] = []
    ends: list[int] = []
    for m in regex.finditer(PATTERN, text):
        word, at = m.group(), m.start()
        tokens = enc.encode_ordinary(word)
        if len(tokens) > 1:
            seen, chars = b"", 0
            for t in tokens[:-1]:
                seen += enc.decode_single_token_bytes(t)
                try:
                    chars += len(seen.decode())
                    seen = b""
                    letters.append("c")
                except UnicodeDecodeError:
                    letters.append("x")
                ends.append(at + chars)
        end = m.end()
        letters.append(_kind(text, word, end))
        ends.append(end)
    return "".join(letters), ends


def shadow_frames(frames: Iterator[pd.DataFrame], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Iterator[pd.DataFrame]:
    """tokens, letters and ends in place of text, in frames of about ROOM characters: what a worker holds doesn't depend on how many rows it is sent at once."""
    for f in frames:
        room = (f["text"].str.len().cumsum() // ROOM).to_numpy()
        cuts = [0, *(i for i in range(1, len(f)) if room[i] != room[i - 1]), len(f)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                some = f.iloc[a:b]
                made = [shadow(t, folder, vocabulary) for t in some["text"]]
                # the characters that each token completes: a piece is a slice of them, whereas a substring would walk the text from its start
                cut = [[t[i:j] for i, j in zip([0, *m[1]], m[1])] for t, m in zip(some["text"], made)]
                yield some.assign(tokens=cut, letters=[m[0] for m in made], ends=[m[1] for m in made]).drop(columns="text")


def _kind(text: str, word: str, end: int) -> str:
    if end == len(text):
        return "P"
    nxt = text[end]
    if "\n" in word:
        return "P" if word.count("\n") > 1 else "L"
    tail = word.rstrip()[-1:] if not word.isspace() else ""
    if nxt == "\n":
        return "W"  # the line break belongs to the piece that it ends
    if tail and tail in ".!?…。！？" and nxt.isspace():
        return "S"
    if tail and tail in ",;:)»”" and nxt.isspace():
        return "C"
    return "W"


def pattern(limit: str = "%1$d", floor: str = "%2$d") -> str:
    """Alternatives by boundary strength; a stronger boundary is taken only if the piece gets at least `floor` tokens."""
    parts = [f".{{{floor},{limit}}}(?<={k})" for k in ("P", "[PL]", "[PLS]", "[PLSC]")]
    return "|".join([f".{{1,{limit}}}$", *parts, f".{{1,{limit}}}(?<=[PLSCW])", f".{{1,{limit}}}(?<!x)", f".{{1,{limit}}}"])


def running(sizes: Column, width: int = 256) -> Column:
    """0 and the running sums of an array. An array is copied whenever it grows, so sums run inside stretches of `width` first."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    count = F.size(sizes)
    parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / width).cast("int")), lambda b: F.slice(sizes, b * width + 1, width))
    inner = F.transform(parts, lambda p: F.aggregate(p, F.array(F.lit(0)), step))
    base = F.aggregate(inner, F.array(F.lit(0)), lambda acc, p: step(acc, F.element_at(p, -1)))
    moved = F.transform(inner, lambda p, i: F.transform(F.slice(p, 2, width), lambda x: x + F.get(base, i)))
    return F.concat(F.array(F.lit(0)), F.flatten(moved))


def split_oversized(docs: DataFrame, limits: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces (key, piece_no, n_pieces, n_tokens, overlap_tokens, start_char, end_char, piece) of documents above their source's limit.

    A piece has at most max_tokens tokens: the new ones, up to max_tokens - overlap_tokens, after the last overlap_tokens of
    the piece before (fewer only if a token there ends inside a character). Texts within the limit, null texts and sources
    without limits give no rows; a null or negative overlap counts as 0, one of max_tokens or more as max_tokens - 1.
    Cuts inside a word can change the token count of a piece when it is tokenized again; they occur only where a single
    word exceeds the limit.
    """
    big = oversized(docs, limits, key, folder, vocabulary)

    schema = f"{key} {dict(docs.dtypes)[key]}, max_tokens int, overlap int, tokens array<string>, letters string, ends array<int>"
    s = big.repartition(key).mapInPandas(lambda frames: shadow_frames(frames, folder, vocabulary), schema)
    fresh = F.col("max_tokens") - F.col("overlap")
    first = F.format_string(pattern("%1$d", "%2$d"), "max_tokens", F.greatest(F.lit(1), F.expr("max_tokens div 2")))
    later = F.format_string(pattern("%1$d", "%2$d"), fresh, F.greatest(F.lit(1), F.floor(fresh / 2).cast("int")))
    s = s.withColumns({"first": F.concat(F.lit("^(?:"), first, F.lit(")")), "later": later})
    s = s.withColumn("head", F.expr("regexp_extract(letters, first, 0)"))
    s = s.withColumn("tail", F.expr("regexp_extract_all(substring(letters, length(head) + 1), later, 0)"))
    sizes = F.concat(F.array(F.length("head")), F.transform("tail", F.length))
    s = s.withColumn("cuts", running(sizes))
    piece = s.select(key, "tokens", "letters", "ends", "overlap", (F.size("cuts") - 1).alias("n_pieces"), F.posexplode(F.slice("cuts", 2, F.size("cuts"))).alias("__i", "__to"), "cuts")
    begin = piece.withColumn("__new", F.col("cuts")[F.col("__i")])
    back = F.greatest(F.lit(0), F.when(F.col("__i") == 0, 0).otherwise(F.col("__new") - F.col("overlap")))
    begin = begin.withColumn("__back", back)
    # the overlap starts at a whole character: skip tokens that end inside one
    skip = F.when(F.col("__back") == 0, 0).otherwise(F.length(F.regexp_extract(F.expr("substring(letters, __back, 8)"), "^x+", 0)))
    begin = begin.withColumn("__from", F.least(F.col("__back") + skip, F.col("__new")))
    at = lambda c: F.when(F.col(c) == 0, 0).otherwise(F.element_at("ends", F.col(c)))
    out = begin.withColumns({"start_char": at("__from"), "end_char": at("__to")})
    return out.select(
        key, (F.col("__i") + 1).alias("piece_no"), "n_pieces", (F.col("__to") - F.col("__from")).alias("n_tokens"), (F.col("__new") - F.col("__from")).alias("overlap_tokens"),
        "start_char", "end_char", F.array_join(F.slice("tokens", F.col("__from") + 1, F.col("__to") - F.col("__from")), "").alias("piece"),
    )


def oversized(docs: DataFrame, limits: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text, max_tokens, overlap) of the documents with more than max_tokens tokens; of repeated limits of one source the smallest holds."""
    lim = limits.filter("source IS NOT NULL AND max_tokens > 0").groupBy("source").agg(F.min("max_tokens").alias("max_tokens"), F.min("overlap_tokens").alias("__o"))
    over = F.least(F.greatest(F.coalesce("__o", F.lit(0)), F.lit(0)), F.col("max_tokens") - 1)
    d = docs.select(key, "text", "source").join(lim, "source").select(key, "text", "max_tokens", over.alias("overlap"))
    return d.filter(over_limit(F.col("text"), F.col("max_tokens"), folder, vocabulary))
