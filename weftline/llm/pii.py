"""Problem 4: personal information in free text, by information-theoretic sanitisation.

Protected entities with a form of their own (email, phone, identity number, street address) are found by patterns. Names
have none; they are found by how strongly terms reveal protected entities. Over the whole corpus, terms are counted in
free text, inside the local parts of email addresses, and next to each other. A term's disclosure is the pointwise mutual
information between the term and an email's owner; terms above a threshold are disclosing. So are terms that stand next to
disclosing terms most of the time and on both sides (a cue word such as "signed" stands on one side only). Two adjacent
disclosing terms, or one with an initial, are a name. Found entities are generalised to typed placeholders; a single
disclosing term is generalised too, since it reveals its owner.

Texts are compared after NFKC and without zero-width characters; a text without findings comes out as it was.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

KINDS = ("email", "phone", "id_number", "address", "name")
MIN_BITS = 4.5  # disclosure of an email's owner, in bits
MIN_NEAR = 0.4  # share of a term's occurrences next to a disclosing term
MIN_SIDE = 0.04  # share of these on the rarer side
MIN_SUPPORT = 3
ROUNDS = 3
MEMO = 300_000  # words that a worker remembers
LEXICON_BOUND = 200_000  # disclosing terms sent to the workers; beyond that each text meets its own terms by a join

_DROP = dict.fromkeys([0x00AD, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])

# The public romanisation of Cyrillic letters as used in email addresses.
_LATIN = str.maketrans(
    {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
        "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
        "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ß": "ss", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe",
    }
)

# Written-out signs, number labels and street words by language.
_AT = r"(?:at|ат|собака|arroba|arobase|klammeraffe)"
_DOT = r"(?:dot|точка|punto|point|punkt)"
_EMAIL = re.compile(
    rf"""[a-z0-9](?:[a-z0-9._+\-]*[a-z0-9])?
    (?:@|[ ]@[ ]|\s*[(\[{{<]\s*{_AT}\s*[)\]}}>]\s*|\s+{_AT}\s+(?=[a-z0-9\-]+\s+{_DOT}\s))
    [a-z0-9\-]+(?:(?:\.|\s*[(\[{{]\s*{_DOT}\s*[)\]}}]\s*|\s+{_DOT}\s+)[a-z0-9\-]+)*(?:\.|\s*[(\[{{]\s*{_DOT}\s*[)\]}}]\s*|\s+{_DOT}\s+)[a-z]{{2,}}\b""",
    re.I | re.X,
)
_MAYBE_EMAIL = re.compile(rf"@|[(\[{{<]\s*{_AT}\s*[)\]}}>]|\s{_AT}\s+[a-z0-9\-]+\s+{_DOT}\s", re.I)
_LABEL = (
    r"ssn|social\s+security(?:\s+(?:number|no\.?|num\.?))?|national\s+insurance(?:\s+(?:number|no\.?))?|nino|ni\s+(?:number|no\.?)|passport(?:\s+(?:number|no\.?))?|tax\s+id|itin|id\s+card|identity\s+card"
    r"|инн|снилс|(?:серия\s+и\s+номер\s+)?паспорт\w*|удостоверени\w+|полис\w*"
    r"|(?:personal)?ausweis(?:nummer|nr\.?)?|reisepass(?:nummer|nr\.?)?|steuer-?\s?(?:id|nummer|nr\.?)|sozialversicherungs(?:nummer|nr\.?)|sv-?nummer|rentenversicherungsnummer"
    r"|dni|nie|nif|pasaporte|seguridad\s+social|nir|s[ée]curit[ée]\s+sociale|carte\s+d['’]identit[ée]|passeport|num[ée]ro\s+fiscal"
)
_ID = re.compile(
    rf"""\b(?:{_LABEL})(?![^\W\d_])[ ]*(?:[:=]|(?:number|no|nr|num)\b\.?|n[º°o]\.?|№|\#)?[ ]*
    (?P<n>(?:[a-z]{{1,3}}[ \-]?)?\d[\da-z]*(?:[ .\-/]?(?:(?:№|no\.?)[ ]?)?\d[\da-z]*|[ \-](?-i:[A-Z])(?![\w]))*|[a-z0-9]*\d[a-z0-9]*)
    |\b[a-z]{{2}}[ ]\d\d[ ]\d\d[ ]\d\d[ ][a-d]\b""",
    re.I | re.X,
)
# a text without any of these has no labelled number
_ID_KEYS = (
    "ssn", "social", "insurance", "nino", "ni n", "passport", "tax id", "itin", "id card", "identity", "инн", "снилс", "паспорт", "удостоверен", "полис", "ausweis", "reisepass",
    "steuer", "sozialvers", "sv-nummer", "svnummer", "rentenvers", "dni", "nie", "nif", "pasaporte", "nir", "curité", "curite", "passeport", "fiscal",
)
_NINO = re.compile(r"\b[a-z]{2} \d\d \d\d \d\d [a-d]\b", re.I)
_FREE = r"(?<![\w.+#/=\-])"
_PHONE = re.compile(
    rf"""(?<![\w.\#/=+])\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d(?:[ .\-/]?\d){{6,12}}(?![\w])
    |{_FREE}00\d\d[ .\-]\d{{1,4}}(?:[ .\-/]?\d){{5,10}}(?!\w)
    |{_FREE}[78][ .\-]?\(?\d{{3}}\)?[ .\-]\d{{3}}[ .\-]\d\d[ .\-]\d\d(?![\w\-])
    |(?<![\w.+\#/=\-])(?:1[ .\-])?(?:\(\d{{3}}\)[ .\-]?|\d{{3}}[ .\-])\d{{3}}[ .\-]\d{{4}}(?![\w\-])
    |{_FREE}\(0\d{{1,4}}\)[ .\-/]?\d{{3,8}}(?:[ \-]\d{{1,6}})?(?![\w\-])
    |{_FREE}0\d{{1,4}}/[ ]?\d{{4,9}}(?:-\d{{1,4}})?(?!\w)
    |{_FREE}0\d{{2,4}}[ .\-]\d{{3,4}}[ .\-]\d{{4}}(?![\w\-])
    |{_FREE}0\d(?:[ .\-]?\d\d){{4}}(?![\w\-])
    |{_FREE}[5-9]\d\d(?:[ .\-]\d\d\d[ .\-]\d\d\d|[ .\-]\d\d[ .\-]\d\d[ .\-]\d\d|\d{{6}})(?![\w\-])""",
    re.X,
)
_MAYBE_PHONE = re.compile(r"\d[\d\s().\-/]{6,}\d")
_NAME_WORD = r"(?!(?:of|the|in|on|at|and|for|to|a|an|with|from)\b)[^\W\d_][\w'’\-]*"
# (words one of which an address of this build has, pattern)
_ADDRESSES = [
    (keys, re.compile(pattern, re.I | re.X))
    for keys, pattern in (
        (
            ("улиц", "ул.", "проспект", "пр-т", "просп.", "переулок", "пер.", "шоссе", "бульвар", "набережн", "наб.", "площадь", "проезд"),
            r"""\b(?:улица|ул\.|проспект|пр-т|просп\.|переулок|пер\.|шоссе|бульвар|набережная|наб\.|площадь|проезд)\s+(?:[^\W\d_][\w\-]*[\s,]+){1,3}
            (?:дом\s+|д\.\s*|№\s*)?\d+(?:[\-/]\d{1,4})?(?:,\s*(?:кв\.|квартира)\s*\d+)?""",
        ),
        (
            ("street", " st", "ave", "road", " rd", "lane", " ln", "drive", " dr", "close", "court", "boulevard", "blvd", "terrace", "crescent", "gardens", "square"),
            rf"""\b(?:flat\s+\d+,\s*)?\d{{1,5}}[a-z]?\s+(?:{_NAME_WORD}\s+){{1,3}}
            (?:street|st\b|avenue|ave\b|road|rd\b|lane|ln\b|drive|dr\b|close|court|boulevard|blvd\b|terrace|crescent|gardens|square)(?!\w)(?:\.?,\s*(?:apt|flat)\s+\d+)?""",
        ),
        (
            ("straße", "strasse", "str.", "allee", "gasse", "weg ", "platz", "chaussee", "damm", "ufer"),
            r"\b[^\W\d_][\w\-]*(?:straße|strasse|str\.|allee|gasse|weg|platz|chaussee|damm|ufer)\s+\d{1,4}\s?[a-z]?\b",
        ),
        (
            ("am ", "an de", "im ", "in der ", "auf der ", "zum ", "zur ", "hinter der ", "unter den "),
            r"""(?-i:\b(?:Am|An\s+der|An\s+den|Im|In\s+der|Auf\s+der|Zum|Zur|Hinter\s+der|Unter\s+den|AM|IM|ZUM|ZUR)\s+(?:[A-ZÄÖÜ][\w\-]+\s+){1,2}\d{1,4}\s?[a-zA-Z]?\b)
            |\bam\s+alten\s+[^\W\d_]+\s+\d{1,4}\b""",
        ),
        (
            ("calle", "c/", "avenida", "avda", "paseo", "plaza", "camino", "ronda", "travesía"),
            r"""(?:\bcalle|\bc/|\bavenida|\bavda\.?|\bpaseo|\bplaza|\bcamino|\bronda|\btravesía)\s+(?:[^\W\d_][\w\-]*\s+){0,5}[^\W\d_][\w\-]*,?\s+(?:n[.º°]*\s*)?\d{1,4}\b""",
        ),
        (
            ("rue", "avenue", "av.", "chemin", "boulevard", "bd ", "place", "allée", "impasse", "quai", "route", "cours", "passage"),
            r"""\b\d{1,4}(?:\s?(?:bis|ter|[a-d]))?,?\s+(?:rue|avenue|av\.|chemin|boulevard|bd|place|allée|impasse|quai|route|cours|passage)\s+
            (?:(?:de|du|des|la|le|les|d['’]|l['’])\s*){0,2}[^\W\d_][\w'’\-]*(?:\s+[A-ZÀ-Ý][\w'’\-]*)?""",
        ),
    )
]
_HOUSE = re.compile(r"(?<![\w#/`.\-])\d{1,5}")
_EDGE = "\"'«»“”„‚‘’([{<>)]}*|~—–-"
_MARKS = ".,;:!?…"


_HIDDEN = re.compile("[" + "".join(map(chr, _DROP)) + "]")


def normal(text: str) -> str:
    if text.isascii():
        return text
    if _HIDDEN.search(text):
        text = text.translate(_DROP)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def folded(word: str) -> str:
    """Case folded, romanised, without diacritics."""
    w = word.casefold().translate(_LATIN)
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w).translate(_LATIN) if not unicodedata.combining(c))


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def structured(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of emails, identity numbers, phones and addresses in a normalised text; earlier kinds win over later ones that touch them."""
    out: list[tuple[int, int, str]] = []

    def take(pattern: re.Pattern, kind: str, good=lambda m: True) -> None:
        for m in pattern.finditer(text):
            a, b = m.span()
            if good(m) and all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))

    low = text.lower()
    if "@" in low or _MAYBE_EMAIL.search(low):
        take(_EMAIL, "email")
    if any(k in low for k in _ID_KEYS) or _NINO.search(low):
        take(_ID, "id_number", lambda m: _digits(m.group("n") or m.group()) >= 5)
    if _MAYBE_PHONE.search(text):
        take(_PHONE, "phone", lambda m: 8 <= _digits(m.group()) <= 15)
    if _HOUSE.search(text):
        for keys, pattern in _ADDRESSES:
            if any(k in low for k in keys):
                take(pattern, "address")
    return out


def tokens(text: str) -> list[tuple[str, str]]:
    """(core, mark) of the blank-separated tokens: the core without quotes and brackets, the sentence mark after it."""
    out = []
    for t in text.split():
        core = t.strip(_EDGE)
        bare = core.rstrip(_MARKS)
        mark = core[len(bare) :]
        if mark:
            bare = bare.rstrip(_EDGE)
        out.append((bare, mark))
    return out


class Lexicon:
    """Disclosing terms with a memory of the words and raw tokens met."""

    def __init__(self, terms):
        self.terms = terms
        self.words: dict[str, bool] = {}
        self.raw: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        hit = self.words.get(word)
        if hit is None:
            if len(self.words) > MEMO:
                self.words.clear()
            hit = self.words[word] = len(word) > 1 and word.isalpha() and folded(word) in self.terms
        return hit

    def touches(self, text: str) -> bool:
        """Whether any token of the text is a disclosing term."""
        raw = self.raw
        for t in text.split():
            hit = raw.get(t)
            if hit is None:
                if len(raw) > MEMO:
                    raw.clear()
                hit = raw[t] = any(w in self for w, _ in tokens(t))
            if hit:
                return True
        return False


def name_tokens(text: str, lexicon) -> list[tuple[int, int, bool]]:
    """(first, last token, whether it is a full name) of the names and single disclosing terms of a text whose structured entities are blanked."""
    if not lexicon.touches(text):
        return []
    ts = tokens(text)
    known = [w in lexicon for w, _ in ts]
    out: list[tuple[int, int, bool]] = []
    i = 0
    while i < len(ts):
        if known[i]:
            j = i
            while j + 1 < len(ts) and known[j + 1] and ts[j][1] in ("", ","):
                j += 1
            if j > i:
                out.append((i, j, True))
            elif i + 1 < len(ts) and ts[i][1] in ("", ",") and len(ts[i + 1][0]) == 1 and ts[i + 1][0].isalpha() and ts[i + 1][1].startswith("."):
                out.append((i, i + 1, True))
                j = i + 1
            elif i and len(ts[i - 1][0]) == 1 and ts[i - 1][0].isalpha() and ts[i - 1][1] == ".":
                out.append((i - 1, i, True))
            else:
                out.append((i, i, False))
            i = j
        i += 1
    return out


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, _ in spans:
        text = text[:a] + "\x00" * (b - a) + text[b:]
    return text


def kinds_of(text: str, lexicon) -> set[str]:
    t = normal(text)
    spans = structured(t)
    found = {k for _, _, k in spans}
    if any(full for _, _, full in name_tokens(blanked(t, spans), lexicon)):
        found.add("name")
    return found


def sanitised(text: str, lexicon) -> tuple[str, list[str]]:
    """(text with typed placeholders, kinds found)."""
    t = normal(text)
    spans = structured(t)
    clear = blanked(t, spans)
    kinds = {k for _, _, k in spans}
    names = name_tokens(clear, lexicon)
    if names:
        at = [m.span() for m in re.finditer(r"\S+", clear)]
        for i, j, full in names:
            a = at[i][0] + len(clear[at[i][0] : at[i][1]]) - len(clear[at[i][0] : at[i][1]].lstrip(_EDGE))
            last = clear[at[j][0] : at[j][1]]
            b = at[j][0] + len(last.rstrip(_EDGE + _MARKS)) + (1 if full and len(last.strip(_EDGE).rstrip(_MARKS)) == 1 else 0)
            spans.append((a, b, "name"))
            if full:
                kinds.add("name")
    if not spans:
        return text, []
    out, end = [], 0
    for a, b, k in sorted(spans):
        out += [t[end:a], f"[{k.upper()}]"]
        end = b
    return "".join([*out, t[end:]]), sorted(kinds)


def _counts(texts: list[str], memo: dict[str, tuple[str, bool]]) -> dict[tuple[str, str, str], int]:
    """(kind, a, b) counts: m terms of email local parts, u words, b adjacent words. memo: raw token to (folded word or nothing, whether the next word is adjacent)."""
    mail: Counter = Counter()
    words: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for text in texts:
        t = normal(text)
        low = t.lower()
        if "@" in low or _MAYBE_EMAIL.search(low):
            spans = [m.span() for m in _EMAIL.finditer(t)]
            for a, b in spans:
                local = re.split(r"@|\s|[(\[{<]", t[a:b], maxsplit=1)[0]
                mail.update(p for p in re.split(r"[._+\-\d]+", local.casefold()) if len(p) > 2)
            t = blanked(t, [(a, b, "") for a, b in spans])
        before = ""
        for raw in t.split():
            hit = memo.get(raw)
            if hit is None:
                if len(memo) > MEMO:
                    memo.clear()
                [(w, mark)] = tokens(raw) or [("", "")]
                hit = memo[raw] = (folded(w) if len(w) > 1 and w.isalpha() else "", mark in ("", ","))
            f, goes_on = hit
            if f:
                words[f] = words.get(f, 0) + 1
                if before:
                    k = (before, f)
                    pairs[k] = pairs.get(k, 0) + 1
                before = f if goes_on else ""
            else:
                before = ""
    return {("m", p, ""): n for p, n in mail.items()} | {("u", w, ""): n for w, n in words.items()} | {("b", *k): n for k, n in pairs.items()}


def disclosure(df: DataFrame) -> DataFrame:
    """(term, bits, near, n): the disclosing terms of the corpus. Counts cover all rows with a text; deliveries repeated with the same text count once each key if df is distinct."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, bool]] = {}
        for f in frames:
            c = _counts(f["text"].tolist(), memo)
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["kind", "a", "b", "n"])

    counted = df.filter("text IS NOT NULL").select("text").mapInPandas(run, "kind string, a string, b string, n long")
    counted = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counted, _ = materialize(counted, "terms")
    mail = counted.filter("kind = 'm'").select(F.col("a").alias("term"), F.col("n").alias("n_mail"))
    free = counted.filter("kind = 'u'").select(F.col("a").alias("term"), F.col("n").alias("n_free"))
    pairs = counted.filter("kind = 'b'").select("a", "b", "n")
    total = counted.agg(F.sum(F.when(F.col("kind") == "m", F.col("n"))).alias("m"), F.sum(F.when(F.col("kind") == "u", F.col("n"))).alias("u")).first()
    n_mail, n_free = total["m"] or 0, total["u"] or 0
    spark = df.sparkSession
    if not n_mail or not n_free:
        return spark.createDataFrame([], "term string, bits double, near double, n long")
    base = n_mail / (n_mail + n_free)
    share = F.col("n_mail") / (F.col("n_mail") + F.coalesce("n_free", F.lit(0)))
    seeds = mail.join(free, "term", "left").withColumn("bits", F.log2(share / F.lit(base)))
    seeds, _ = materialize(seeds.filter(F.col("bits") >= min(MIN_BITS, 0.7 * -log2(base))).select("term", "bits"), "seeds")
    known = seeds.select("term")
    for _ in range(ROUNDS):
        left = pairs.join(known.select(F.col("term").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("term")).agg(F.sum("n").alias("l"))
        right = pairs.join(known.select(F.col("term").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("term")).agg(F.sum("n").alias("r"))
        near = left.join(right, "term", "full").join(free, "term").fillna(0, ["l", "r"])
        near = near.select("term", "n_free", (F.col("l") + F.col("r")).alias("s"), F.least("l", "r").alias("low"))
        # an occurrence has neighbours on both sides; the share is of occurrences that touch a disclosing term
        near, _ = materialize(near.withColumn("near", F.least(F.lit(1.0), F.col("s") / F.col("n_free"))), "near")
        grown = near.filter((F.col("near") >= MIN_NEAR) & (F.col("s") >= MIN_SUPPORT) & (F.col("low") >= 1) & (F.col("low") >= MIN_SIDE * F.col("s"))).select("term")
        # a seed that is common in free text but hardly ever next to another is an ordinary word
        plain = free.join(near.select("term", "near"), "term", "left").filter((F.col("n_free") >= 20) & (F.coalesce("near", F.lit(0.0)) < 0.1)).select("term")
        known, _ = materialize(seeds.select("term").join(plain, "term", "left_anti").union(grown).distinct(), "known")
    return known.join(seeds, "term", "left").join(near.select("term", "near", F.col("n_free").alias("n")), "term", "left").select("term", "bits", "near", "n")


def _with_lexicon(events: DataFrame, lexicon: DataFrame, bound: int):
    """A broadcast lexicon of at most `bound` terms, or None if there are more."""
    terms = [r["term"] for r in lexicon.select("term").limit(bound + 1).collect()]
    return events.sparkSession.sparkContext.broadcast(frozenset(terms)) if len(terms) <= bound else None


_lexicons: dict[int, Lexicon] = {}


def _lexicon(held) -> Lexicon:
    key = id(held.value)
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(held.value)
    return _lexicons[key]


def _with_terms(d: DataFrame, lexicon: DataFrame) -> DataFrame:
    """d with an array __terms of the disclosing terms in each row's text: the way for a lexicon of any size."""
    d, _ = materialize(d.withColumn("__row", F.monotonically_increasing_id()), "rows")

    def words_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["term"] = [sorted({folded(w) for w, _ in tokens(blanked(x, structured(x))) if len(w) > 1 and w.isalpha()}) for x in map(normal, f["text"])]
            yield f.drop(columns="text").explode("term").dropna(subset=["term"])

    met = d.filter("text IS NOT NULL").select("__row", "text").mapInPandas(words_of, "__row long, term string").join(lexicon.select("term").distinct(), "term", "left_semi")
    own = met.groupBy("__row").agg(F.collect_set("term").alias("__terms"))  # terms of one text
    return d.join(own, "__row", "left").drop("__row")


def _scanned(events: DataFrame, keys: list[str], d: DataFrame, lexicon: DataFrame | None, bound: int, schema: str, one) -> DataFrame:
    """Frames of d with a Lexicon for each row go through `one`: a broadcast lexicon, or beyond the bound the terms of the row itself."""
    lexicon = disclosure(d) if lexicon is None else lexicon
    held = _with_lexicon(events, lexicon, bound)
    types = dict(events.dtypes)
    x = d if held is not None else _with_terms(d, lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if held is not None:
                own = [_lexicon(held)] * len(f)
            else:
                own = [Lexicon(frozenset() if t is None else frozenset(t)) for t in f["__terms"]]
                f = f.drop(columns="__terms")
            yield one(f, own)

    return x.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {schema}")


def find(events: DataFrame, keys: list[str], lexicon: DataFrame | None = None, bound: int = LEXICON_BOUND) -> DataFrame:
    """(keys, kind): the kinds of personal information in each row's text, distinct. Null texts have none."""

    def one(f: pd.DataFrame, own: list[Lexicon]) -> pd.DataFrame:
        f["kind"] = [sorted(kinds_of(t, x)) for t, x in zip(f["text"], own)]
        return f.drop(columns="text").explode("kind").dropna(subset=["kind"])

    d = events.filter("text IS NOT NULL").select(*keys, "text").distinct()
    return _scanned(events, keys, d, lexicon, bound, "kind string", one).distinct()


def redact(events: DataFrame, keys: list[str], lexicon: DataFrame | None = None, bound: int = LEXICON_BOUND) -> DataFrame:
    """(keys, text, kinds): texts with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of what was found. Null texts stay null."""

    def one(f: pd.DataFrame, own: list[Lexicon]) -> pd.DataFrame:
        made = [(None, []) if t is None else sanitised(t, x) for t, x in zip(f["text"], own)]
        f["text"], f["kinds"] = [m[0] for m in made], [m[1] for m in made]
        return f

    return _scanned(events, keys, events.select(*keys, "text").distinct(), lexicon, bound, "text string, kinds array<string>", one)
