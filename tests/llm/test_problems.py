"""The ten problems' text operators on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.llm import conversations as conv
from weftline.llm import languages, leaks, mixing, overlap, pieces, pii, sampling, splits, tokens

T0 = datetime(2030, 1, 1)


# 2: languages
SENTENCES = {
    "en": ["The planner removed the second heading of the report.", "Please restore the old version of this table before the review.", "Nobody noticed that the numbers were wrong again."],
    "de": ["Der Planer hat die zweite Überschrift des Berichts entfernt.", "Bitte stelle die alte Fassung dieser Tabelle vor der Durchsicht wieder her.", "Niemand hat gemerkt, dass die Zahlen wieder falsch waren."],
    "ru": ["Планировщик удалил второй заголовок отчёта.", "Пожалуйста, верни прежнюю версию этой таблицы перед проверкой.", "Никто не заметил, что числа снова неверны."],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(" ".join(rng.sample(s, 2)), x) for x, s in SENTENCES.items() for _ in range(40)]
    rows += [(" ".join(SENTENCES["ru"]), "en")] * 6  # wrong labels
    return languages.fit(rows, ("ru", "en", "de"))


def test_language_of_plain_mixed_and_code(model):
    en, de, ru = (SENTENCES[x] for x in ("en", "de", "ru"))
    texts = [en[0] + " " + en[1], de[0].upper() + " " + de[1], ru[2] + " `foo.bar()` " + ru[0], en[0] + " " + ru[1], "> " + de[0] + "\n" + ru[2], '```\n{"tool": "x", "rows": 3}\n```', "", "x" * 20000, en[2] + "\n[2031-01-07 06:13:16] WARN retry 4 of 9 at x code=415"]
    found = [f["language"] for f in languages.infer(texts, model)]
    assert found[:5] == ["en", "de", "ru", "mixed", "mixed"] and found[5] is None and found[6] is None and found[8] == "en"
    mixed = languages.infer([texts[3]], model)[0]
    assert [s[2] for s in mixed["segments"]] == ["en", "ru"] and set(mixed["proportions"]) == {"en", "ru"}
    assert all(0 <= s[3] <= 1 for s in mixed["segments"]) and 0.5 < mixed["confidence"] <= 1
    a, b = mixed["segments"][1][:2]
    assert texts[3][a:b].strip() == ru[1]


def test_wrong_labels(spark, model):
    en, ru = SENTENCES["en"], SENTENCES["ru"]
    rows = [(1, "en-US", en[0]), (2, "EN", en[1] + en[2]), (3, "ru", en[0] + " " + en[1]), (4, None, ru[0] + ru[1]), (5, "", ru[1]), (6, "mixed", en[0] + " " + ru[1]), (7, "ru", en[0] + " " + ru[1]), (8, "en", None), (9, None, "short"), (3, "ru", en[0] + " " + en[1])]
    df = spark.createDataFrame(rows, "k int, language string, text string")
    got = languages.wrong_labels(languages.identify(df, ["k"], model=model))
    assert {r["k"] for r in got.collect()} == {3, 4, 5, 7}
    assert languages.identify(df.limit(0), ["k"], ("ru", "en", "de")).count() == 0


def test_languages_come_from_labels_and_others_are_rejected(spark, model):
    others = ["Ten pociąg odjeżdża z peronu drugiego o godzinie ósmej rano i wraca wieczorem.", "Il gatto è andato a casa della nonna per mangiare la torta di mele con gli amici."]
    assert [f["language"] for f in languages.infer(others, model)] == [None, None]
    wide = SENTENCES["en"][0].translate({c: c + 0xFEE0 for c in range(0x21, 0x7F)})
    assert languages.infer([wide], model)[0]["language"] == "en"
    rows = [(i, x, " ".join(SENTENCES[x[:2].lower()])) for i, x in enumerate(["en-GB", "DE", "ru"] * 40)] + [(900, "und", "?"), (901, "mixed", "?"), (902, None, "ok"), (903, "en", "")]
    df = spark.createDataFrame(rows, "k int, language string, text string")
    assert languages.labelled_languages(df) == ("de", "en", "ru") and languages.labelled_languages(df.limit(0)) == ()
    got = {r["k"]: r for r in languages.identify(df, ["k"]).collect()}
    assert len(got) == len(rows) and got[0]["found"] == "en" and got[900]["found"] is None and got[902]["confidence"] < 0.6
    assert {r["found"] for r in languages.identify(df.filter("k >= 900"), ["k"], ()).collect()} == {None}


# 3: overlap
def test_overlaps_in_many_shards(spark):
    rng = random.Random(33)
    words = ["planner", "report", "heading", "merged", "skipped", "budget", "token", "session"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(7, 30))) for _ in range(80)]
    rows = [(f"{k}{i}", k, t if k == "train" else t[: len(t) - rng.randrange(9)] + "!") for k in ("train", "eval") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "tid string, side string, text string")
    whole = {tuple(r) for r in overlap.class_pairs(df).collect()}
    assert whole == {tuple(r) for r in overlap.class_pairs(df, shard=7, block=5).collect()} and len(whole) >= 70


def test_overlaps_copy_no_texts_to_shards(spark):
    rng = random.Random(34)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(f"{k}{i}", k, t + "!" * (k == "eval")) for k in ("train", "eval") for i, t in enumerate(texts)], "tid string, side string, text string").cache()
    sc, wrote = spark.sparkContext, []
    df.count()
    for sizes in ({}, {"shard": 2, "block": 2}):
        before = {s.stageId() for s in _stages(sc)}
        assert overlap.class_pairs(df, **sizes).count() == 60
        wrote.append(sum(s.shuffleWriteBytes() for s in _stages(sc) if s.stageId() not in before))
    assert wrote[1] < 2 * wrote[0] + 100_000  # 30 x 30 shards and blocks of 20 kB of texts


def _stages(sc) -> list:
    none = sc._jvm.java.util.ArrayList
    found = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return [found.apply(i) for i in range(found.size())]


def test_sketches_keep_similar_texts():
    import numpy as np
    import pandas as pd
    from weftline.operators.textsim import grams, hashes

    rng = random.Random(35)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (40, 90, 250, 255, 260, 600, 3000, 90_000)]
    texts = base + [t[: len(t) * 9 // 10] + "zz" for t in base] + [t[: len(t) * 2 // 3] for t in base]
    h = [hashes(t) for t in texts]
    s = overlap.Sketches(pd.DataFrame({"n": range(len(texts)), "size": [len(x) for x in h], "marks": [overlap.sketch(x) for x in h]}))
    got = {(int(a), int(b)) for x, y in s.pairs(s, 0.7) for a, b in zip(x, y)}
    g = [grams(t) for t in texts]
    want = {(a, b) for a in range(len(g)) for b in range(len(g)) if len(g[a] & g[b]) / len(g[a] | g[b]) >= 0.7}
    assert want <= got and len(want) > len(texts) and len(got) < 2 * len(want)
    assert overlap.shards_by_size([(5, 3, 3), (6, 9, 9), (7, 1, 1), (8, 2, 2), (9, 2, 2)], 4) == [(5, 5, 0, 1), (6, 6, 0, 3), (6, 6, 1, 3), (6, 6, 2, 3), (7, 8, 0, 1), (9, 9, 0, 1)]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    words = ["planner", "report", "heading", "merged", "skipped", "near", "budget", "token", "session", "history", "review", "before"]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(words) + (str(rng.randrange(9999)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(6, 30)))
        rows.append((f"t{i}", "train", t))
        u = t.split()
        for _ in range(rng.randrange(4)):
            u[rng.randrange(len(u))] = rng.choice(words)
        rows.append((f"e{i}", rng.choice(["test", "calibration"]), ("  ＡB " if i == 0 else "") + " ".join(u).upper()))
    rows += [("n1", None, rows[0][2]), ("n2", "test", None), (None, "test", rows[0][2]), ("same", "train", rows[0][2]), ("same2", "test", rows[0][2]), ("both", "train", rows[2][2]), ("both", "test", rows[2][2])]
    rows += [("short1", "train", "too short"), ("short2", "test", "too short"), ("long1", "train", "ab c" * 5000), ("long2", "test", "ab c" * 5000 + "x"), ("e1", "test", rows[3][2])]
    df = spark.createDataFrame([(*r, "src") for r in rows], "input_id string, split string, text string, source_dataset string")
    from weftline.functions.text import fold_text
    from weftline.operators.textsim import grams

    side = lambda *s: {(i, fold_text(t)) for i, x, t in rows if i and t and x in s and len(fold_text(t)) >= 40}
    want = set()
    for a, x in side("train"):
        for b, y in side("test", "calibration"):
            g, h = grams(x), grams(y)
            if a != b and len(g & h) / len(g | h) >= 0.7:
                want.add((a, b))
    got = {(r["train_input"], r["eval_input"]) for r in overlap.overlaps(df).collect()}
    assert got == want and len(want) > 20
    assert overlap.overlap_report(df).agg(F.sum("n_pairs")).first()[0] >= len(want)
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_overlaps_of_short_texts_with_edits_at_the_ends(spark):
    train = ["the export job stops after the third retry", "please rename the second heading of my report", "ab c" * 12 + "the end"]
    evals = ["so, the export job stops after the third retry!", "OK please rename the second heading of my report", "please rename the secXYZheading of my report", "x" + "ab c" * 12 + "the end?"]
    rows = [(f"t{i}", "train", t) for i, t in enumerate(train)] + [(f"e{i}", "test", t) for i, t in enumerate(evals)]
    got = {(r["train_input"], r["eval_input"]): r for r in overlap.overlaps(spark.createDataFrame(rows, "input_id string, split string, text string")).collect()}
    from weftline.functions.text import fold_text
    from weftline.operators.textsim import grams

    want = {}
    for i, x in enumerate(train):
        for k, y in enumerate(evals):
            g, h = grams(fold_text(x)), grams(fold_text(y))
            if len(g & h) / len(g | h) >= 0.7:
                want[f"t{i}", f"e{k}"] = len(g & h) / len(g | h)
    assert set(got) == set(want) and {("t0", "e0"), ("t1", "e1"), ("t2", "e3")} <= set(want)
    assert all(abs(got[p]["similarity"] - x) < 1e-9 for p, x in want.items()) and abs(got["t0", "e0"]["coverage"] - 43 / 47) < 1e-9


# 4: personal information
LEX = pii.Lexicon({"iris", "corvenby", "vetrohval", "lidiya", "julian"})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to iris.corvenby@letters.test now", {"email"}), ("raisa (at) mailbox (dot) example", {"email"}), ("sable @ post.test", {"email"}), ("Mention @core-15 in the notes.", set()),
        ("The decorator @cached(ttl=32) is missing.", set()), ("call +7 (099) 000-32-85", {"phone"}), ("call 020 7946 0854 or 500000026", {"phone"}), ("＋１ ５５５ ５５５ ０１０５", {"phone"}),
        ("Build 457-1343-22120 passed, sha 9f57c34e07, port 8019", set()), ("Version 3.14.66 replaced 3.13.45 on 2031-04-14.", set()), ("ssn:666632092", {"id_number"}), ("паспорт 00 50 606129", {"id_number"}),
        ("СНИЛС 000-133-186 42\n+1 555 555 0101", {"id_number", "phone"}), ("#nirikven63202 failed", set()), ("at 172 Hollowbeck Lane, now", {"address"}), ("Step 78 of the lane parser runs", set()),
        ("улица Лазоревая, дом 32", {"address"}), ("Steinbrückenallee 153", {"address"}), ("95 bis, avenue du Vieux Lavoir", {"address"}), ("C/ Almendro Azul 59", {"address"}), ("Ask Iris Corvenby about it", {"name"}),
        ("CORVENBY, IRIS", {"name"}), ("Ветрохвал Л.", {"name"}), ("I. Corvenby", {"name"}), ("Julián Corvenby", {"name"}), ("iris opened", set()), ("field is [EMAIL] already", set()), ("", set()), ("x" * 30000, set()),
    ],
)
def test_kinds(text, kinds):
    assert pii.kinds_of(text, LEX) == kinds


def test_redaction_keeps_the_rest(spark):
    out, kinds = pii.sanitised("Ask Iris Corvenby, mail iris@letters.test, today. Plain text stays.", LEX)
    assert out == "Ask [NAME], mail [EMAIL], today. Plain text stays." and kinds == ["email", "name"]
    rows = [(i, f"Ask {g} {f} about it. mail {g.lower()}.{f.lower()}@post.test") for i, (g, f) in enumerate([("Iris", "Corvenby"), ("Corvenby,", "Iris"), ("Owen", "Wexmoor"), ("Wexmoor", "Owen")] * 5)]
    rows += [(100, "Signed: Owen Corvenby"), (101, None), (102, ""), (103, "Signed: the agent removed the heading and the agent stayed quiet")] + [(200 + i, "the agent removed the heading near the table") for i in range(30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k int, text string, kind string")
    terms = {r["term"] for r in pii.disclosure(df).collect()}
    assert {"iris", "corvenby", "owen", "wexmoor"} <= terms and not terms & {"agent", "signed", "ask", "the"}
    found = {(r["k"], r["kind"]) for r in pii.find(df, ["k"]).collect()}
    assert (100, "name") in found and (0, "email") in found and not any(k in (101, 102, 103) for k, _ in found)
    assert {(r["k"], r["kind"]) for r in pii.find(df, ["k"], bound=1).collect()} == found  # the way by joins
    red = {r["k"]: r["text"] for r in pii.redact(df, ["k"]).collect()}
    assert red[100] == "Signed: [NAME]" and red[101] is None and red[102] == "" and red[200] == rows[-1][1]
    assert {(r["k"], r["text"]) for r in pii.redact(df, ["k"], bound=1).collect()} == set(red.items())
    assert pii.find(df.limit(0), ["k"]).count() == 0


# 5: sampling
def test_sample_is_stable(spark):
    rows = [(f"r{i:04}", T0 + timedelta(seconds=i // 3)) for i in range(950)]
    early, more = spark.createDataFrame(rows, "input_id string, ingested_ts timestamp"), [(f"a{i:04}", T0 + timedelta(days=1, seconds=i)) for i in range(300)]
    late = spark.createDataFrame([*rows, *more, *[(k, T0 + timedelta(days=2)) for k, _ in rows[:200]], (None, T0)], "input_id string, ingested_ts timestamp").repartition(5)
    a = {r["input_id"] for r in sampling.block_sample(early).collect()}
    b = {r["input_id"] for r in sampling.block_sample(late).collect()}
    assert a <= b and len(b - a) >= 20 and a == {r["input_id"] for r in sampling.block_sample(early.repartition(3)).collect()}
    full = Counter(r["seq"] // 100 for r in sampling.block_sample(late).collect())
    assert all(full[k] == 10 for k in range(12))
    assert sampling.block_sample(early.limit(0)).count() == 0


def test_sample_with_stored_numbers(spark, tmp_path):
    rows = [(f"r{i:04}", T0 + timedelta(seconds=i)) for i in range(1000)]
    frame = lambda x: spark.createDataFrame(x, "input_id string, ingested_ts timestamp")
    store = str(tmp_path / "numbers")
    a = {r["input_id"] for r in sampling.block_sample(frame(rows), store=store).collect()}
    later = [*rows[:500], ("null", None), ("early", T0 - timedelta(days=9)), (None, T0), *[(f"z{i}", T0 + timedelta(days=1)) for i in range(300)]]
    b = {r["input_id"]: r["seq"] for r in sampling.block_sample(frame(later), store=store).collect()}
    assert a <= set(b) and len(a) == 100 and len(b) >= 125
    numbers = {r["input_id"]: r["seq"] for r in spark.read.parquet(store).collect()}
    assert sorted(numbers.values()) == list(range(1302)) and numbers["early"] == 1000 and numbers["null"] == 1301
    assert {r["input_id"]: r["seq"] for r in sampling.block_sample(frame(later), store=store).collect()} == b
    assert a == {r["input_id"] for r in sampling.block_sample(frame([*rows, ("null", None)])).collect() if r["input_id"] != "null"}


# 6: splits
def test_grouped_splits(spark):
    rng = random.Random(6)
    rows = []
    for s in range(400):
        tenant = f"t{s % 5}"
        for m in range(rng.randrange(1, 6)):
            rows.append((f"i{s}-{m}", tenant, f"s{s}", rng.choice([None, "big" if s % 4 == 0 else f"g{rng.randrange(200)}"]), rng.choice(["train", "test", None])))
    rows += [rows[0], ("multi", "t0", "s0", None, None), ("multi", "t1", "s1", None, None), (None, "t0", "s0", "x", "train"), ("nt", None, "s1", "g1", None), ("ns", "t0", None, None, "train")]
    df = spark.createDataFrame(rows, "input_id string, tenant_id string, session_id string, group_id string, split string")
    targets = spark.createDataFrame([("train", 0.7), ("calibration", 0.15), ("test", 0.15)], "split string, share double")
    got = splits.grouped_splits(df, targets, bins=40)
    one = {r["input_id"]: (r["component"], r["assigned_split"]) for r in got.collect()}
    assert len(one) == got.count() == len({r[0] for r in rows if r[0]})
    assert len({s for _, s in one.values()}) == 3 and len({c for c, _ in one.values()}) == len({(c, s) for c, s in one.values()})
    assert one["i0-0"][1] == one["multi"][1] == one["i1-0"][1]
    shares = {r["split"]: r["actual_share"] for r in splits.share_report(got, targets).collect()}
    assert abs(shares["train"] - 0.7) < 0.08 and abs(sum(shares.values()) - 1) < 1e-9
    crossing = {(r["tenant_id"], r["session_id"]) for r in splits.crossing_sessions(df).collect()}
    comp = {(r["tenant_id"], r["session_id"]): r["component"] for r in splits.session_components(df).collect()}
    seen = {}
    for _, t, s, _, x in rows:
        if x:
            seen.setdefault(comp[(t, s)], set()).add(x)
    assert crossing == {k for k, c in comp.items() if len(seen.get(c, ())) > 1}
    assert splits.grouped_splits(df.limit(0), targets).count() == 0


def test_differencing_balances():
    rng = random.Random(1)
    weights = Counter(rng.randrange(1, 100) for _ in range(300))
    parts = splits.differencing(weights, 10)
    sums = [sum(w * n for w, n in p.items()) for p in parts]
    assert sum((Counter(p) for p in parts), Counter()) == weights and max(sums) - min(sums) <= 5
    assert splits.differencing({}, 3) == [{}, {}, {}] and splits.differencing({7: 2}, 3) == [{7: 1}, {7: 1}, {}]
    got = splits.allocate({1: 1000, 50: 3, 400: 1}, {"train": 0.7, "test": 0.3}, 50)
    assert sum((Counter(p) for p in got.values()), Counter()) == {1: 1000, 50: 3, 400: 1}
    assert abs(sum(w * n for w, n in got["test"].items()) - 0.3 * 1550) < 35


# 7: conversations
def ev(e, parent, seq, role, text, trace="t", t=0, status="completed", tenant="a"):
    return (tenant, trace, e, parent, "main", seq, role, "user_visible", text, status, "en", None, T0, T0 + timedelta(seconds=t))


COLS = "tenant_id string, trace_id string, event_id string, parent_id string, branch_id string, sequence long, role string, visibility string, text string, status string, language string, group_id string, event_ts timestamp, received_ts timestamp"


def test_conversations(spark):
    ok = [ev("u", None, 0, "user", "hi"), ev("a", "u", 1, "assistant", "yes"), ev("u", None, 0, "user", "hi", t=9), ev("t", "a", 5, "tool", "", status="partial"), ev("u2", "t", 6, "user", "  "), ev("u3", "t", 6, "user", "again"), ev("b", "u3", 7, "assistant", "ok", status="cancelled")]
    cases = {
        "ok": ok, "missing": [ev("u", "zz", 0, "user", "hi"), ev("a", "u", 1, "assistant", "x")], "order": [ev("u", None, 3, "user", "hi"), ev("a", "u", 3, "assistant", "x")],
        "cycle": [ev("u", "a", 1, "user", "hi"), ev("a", "u", 2, "assistant", "x")], "edited": [ev("u", None, 0, "user", "hi"), ev("u", None, 0, "user", "ho", t=5), ev("a", "u", 1, "assistant", "x")],
        "empty": [ev("u", None, 0, "user", " \t"), ev("s", None, 1, "system", "prompt")], "unanswered": [*ok, ev("last", "b", 9, "user", "and?")], "sibling": [ev("u", None, 0, "user", "hi"), ev("v", None, 1, "user", "ho"), ev("a", "v", 2, "assistant", "x")],
        "deep": [ev("u", None, 0, "user", "hi"), *[ev(f"n{i}", f"n{i - 1}" if i else "u", i + 1, "tool", "x") for i in range(40)], ev("a", "n39", 99, "assistant", "x")], "nulltext": [ev("u", None, 0, "user", None), ev("a", "u", 1, "assistant", "x")],
    }
    rows = [(r[0], name, *r[2:]) for name, rs in cases.items() for r in rs] + [(None, "ok", *ok[0][2:]), ("a", "ok", None, *ok[0][3:])]
    df = spark.createDataFrame(rows, COLS).repartition(3)
    v = {r["trace_id"]: (r["broken"], r["empty"], r["unanswered"]) for r in conv.verdicts(df).collect()}
    assert v == {
        "ok": (False, False, False), "missing": (True, False, False), "order": (True, False, False), "cycle": (True, False, False), "edited": (True, False, False), "empty": (False, True, False),
        "unanswered": (False, False, True), "sibling": (False, False, True), "deep": (False, False, False), "nulltext": (False, False, False),
    }
    c = conv.conversations(df)
    got = [(r["event_id"], r["turn_no"], r["deleted"]) for r in c.filter("trace_id = 'ok'").orderBy("turn_no").collect()]
    assert got == [("u", 1, False), ("a", 2, False), ("t", 3, False), ("u2", 4, False), ("u3", 5, False), ("b", 6, True)]
    ok = {r["event_id"]: r for r in c.filter("trace_id = 'ok'").collect()}
    assert ok["b"]["text"] is None and {k: (r["depth"], r["thread"]) for k, r in ok.items()} == {"u": (0, "u"), "a": (1, "u"), "t": (2, "u"), "u2": (3, "u"), "u3": (3, "u3"), "b": (4, "u3")}
    assert c.filter("trace_id = 'deep'").agg(F.max("depth")).first()[0] == 41
    assert {r["trace_id"] for r in c.select("trace_id").distinct().collect()} == {"ok", "deep", "nulltext"}
    assert conv.verdicts(df.limit(0)).count() == 0 and conv.conversations(df.limit(0)).count() == 0


# 8: leaks
def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (0, None)]
    docs = []
    for i in range(60):
        t = [rng.choice(vocab) for _ in range(30)]
        src = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(src))
        part = src[a : a + rng.randrange(4, 25)]
        docs.append((i, " ".join(t[:15]) + ", " + "-".join(w.upper() if rng.random() < 0.3 else w for w in part) + " . " + " ".join(t[15:])))
    docs += [(100, None), (101, ""), (102, "w1 " * 20000), (103, "soft­hy ＷＩＤＥ")]
    want = set()
    for d, t in docs:
        ws = leaks.words(t or "")
        runs = {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
        for k, x in items:
            xs = leaks.words(x or "")
            if any(tuple(xs[i : i + 12]) in runs for i in range(len(xs) - 11)):
                want.add((d, k))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard in (leaks.SHARD_WORDS, 60):
        assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(dd, ii, shard_words=shard).collect()} == want
    assert len(want) > 10 and leaks.words("soft­hy ＷＩＤＥ x_y") == ["softhy", "wide", "x", "y"]
    cleaned = {r["doc_id"]: r for r in leaks.clean(dd, ii, max_cover=0.95).collect()}
    assert cleaned[100]["text"] is None and cleaned[100]["action"] == "kept"
    for d in {d for d, _ in want}:
        assert cleaned[d]["action"] == "spans_removed" and cleaned[d]["removed_words"] >= 12
    assert leaks.leaks(cleaned_frame(spark, cleaned), ii).count() == 0
    assert leaks.leaks(dd, ii.limit(0)).count() == 0 and leaks.leaks(dd.limit(0), ii).count() == 0


def cleaned_frame(spark, cleaned):
    return spark.createDataFrame([(k, r["text"]) for k, r in cleaned.items()], "doc_id long, text string")


# 9: mixing
def test_mix_reaches_shares(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "other"]), rng.choice(["word " * rng.randrange(1, 40), "", None])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.2, 2), ("gone", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    s = mixing.sized(df, targets)
    rep = {r["source"]: r for r in mixing.share_report(s, targets).collect()}
    assert rep["gone"]["mixed_tokens"] == 0 and abs(rep["b"]["reachable_share"] - 0.5 / 0.9) < 1e-9
    for k in "abc":
        assert abs(rep[k]["actual_share"] - rep[k]["reachable_share"]) < 0.01 and rep[k]["most_repeats"] <= rep[k]["max_repeats"]
    m = {r["doc_id"]: r["repeats"] for r in mixing.mix(s, targets).collect()}
    assert m == {r["doc_id"]: r["repeats"] for r in mixing.mix(mixing.sized(df.repartition(7), targets), targets).collect()}
    assert not any(docs[k][1] == "other" for k in m)
    for n in (2000, 9000):  # the rest of a budget is small even though single documents are not
        r = {x["source"]: x["mixed_tokens"] for x in mixing.share_report(s, targets, n).collect()}
        want = {x["source"]: x["budget"] for x in mixing.plan(s, targets, n).collect()}
        assert abs(sum(want.values()) - n) <= 4 and all(want[k] * 0.98 - 3 <= r[k] <= want[k] for k in want)
    capped = {x["source"]: x for x in mixing.share_report(s, targets, 10**7).collect()}
    assert all(capped[k]["mixed_tokens"] == capped[k]["own_tokens"] * capped[k]["max_repeats"] for k in "abc")
    one_long = mixing.sized(spark.createDataFrame([(0, "a", "word " * 900), *[(i, "a", "word " * 10) for i in range(1, 200)]], "doc_id long, source string, text string"), targets)
    assert abs(mixing.mix(one_long, targets, 1000).agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] - 1000) <= 12
    assert mixing.mix(mixing.sized(df.limit(0), targets), targets).count() == 0


# 10: pieces
def test_pieces_cover_and_keep_limits(spark):
    rng = random.Random(10)
    para = lambda n: " ".join(rng.choice(["Отчёт", "report", "naïve", "слово", "token", "😀"]) + rng.choice(["", ".", ","]) for _ in range(n))
    texts = ["\n\n".join(para(60) for _ in range(12)), "x" * 5000, "ж" * 3000, "", None, "short text", "a  b\n\n" * 400, "😀" * 700, " " * 900]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)] + [(90, "nolimit", texts[0]), (91, None, texts[0])], "doc_id long, source string, text string")
    limits = spark.createDataFrame([("s", 100, 20), ("nolimit", None, 5)], "source string, max_tokens int, overlap_tokens int")
    got = {}
    for r in pieces.split_oversized(docs, limits).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    enc = tokens.encoding()
    big = {i for i, t in enumerate(texts) if t and len(enc.encode_ordinary(t)) > 100}
    assert set(got) == big and 0 in big and 2 in big
    for i, ps in got.items():
        t, end = texts[i], 0
        assert [p["piece_no"] for p in ps] == list(range(1, ps[0]["n_pieces"] + 1)) == list(range(1, len(ps) + 1))
        for n, p in enumerate(ps):
            assert p["piece"] == t[p["start_char"] : p["end_char"]] and 0 < p["n_tokens"] <= 100
            assert (p["start_char"] <= end < p["end_char"]) if n else p["start_char"] == 0
            assert not n or 12 <= p["overlap_tokens"] <= 20
            end = p["end_char"]
        assert end == len(t)
    ends = [p["piece"][-1] for p in got[0][:-1]]
    assert sum(e in "\n.," or e.isspace() for e in ends) >= len(ends) * 0.8
    assert max(len(enc.encode_ordinary(p["piece"])) for p in got[0]) <= 100
    assert pieces.split_oversized(docs.limit(0), limits).count() == 0


def test_pieces_hold_few_tokens_at_once():
    import tracemalloc

    import pandas as pd

    tokens.encoding()
    texts = [f"{i} " + "planner 12 отчёт, x\n" * 1200 for i in range(60)]
    frame = pd.DataFrame({"doc_id": range(60), "max_tokens": 100, "overlap": 0, "text": texts})
    pieces.shadow(texts[0])
    tracemalloc.start()
    seen = sizes = 0
    for f in pieces.shadow_frames(iter([frame, frame.iloc[:0]])):
        assert ["".join(t) for t in f["tokens"]] == [texts[i] for i in f["doc_id"]] and list(f["letters"].str.len()) == [len(e) for e in f["ends"]]
        seen, sizes = seen + len(f), max(sizes, len(f))
    assert sum(tokens.count_tokens(texts)) > 500_000 and tokens.count_tokens([]) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 60 and sizes < 15 and peak < 40e6  # all texts at once take about 60 MB


def test_entry_has_no_missing_queries():
    from weftline.llm import entry

    assert {f"p{n}_found" for n in (2, 3, 4, 6, 7, 8, 10)} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
