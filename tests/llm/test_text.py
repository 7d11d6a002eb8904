"""Leaks, mixes and garbled texts."""

import random

import pytest
from pyspark.sql import functions as F

from fieldchirp.llm.garbled import garbled_texts
from fieldchirp.llm.leak import leaked_passages, plain_words
from fieldchirp.llm.mix import mix_sources

WORDS = [a + b for a in "ba do ki lu me no pe ra si tu".split() for b in "n r l x".split()]


def test_words():
    assert plain_words("Café NAÏVE, été_x—2nd!") == "cafe naive ete x 2nd"
    assert plain_words("") == "" and plain_words(None) is None


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(say(40))) for i in range(8)] + [(8, "too short"), (9, None), (10, "")]
    docs = []
    for i in range(120):
        w = say(60)
        src = items[rng.randrange(8)][1].split()
        n = rng.choice([0, 11, 12, 13, 30])
        at, into = rng.randrange(len(src) - n + 1), rng.choice([0, 20, 60])
        docs.append((i, ", ".join((w[:into] + [x.upper() for x in src[at : at + n]] + w[into:]))))
    docs += [(900, None), (901, ""), (902, "one"), (903, docs[1][1]), (1, docs[1][1]), (904, " ".join(say(20_000)) + " " + items[0][1])]
    grams = {}
    for i, t in items:
        w = plain_words(t).split() if t else []
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for i, t in docs:
        w = plain_words(t).split() if t else []
        for k in range(len(w) - 11):
            want |= {(i, j) for j in grams.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(1))
    t = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit("clash"))
    got = leaked_passages(d, t)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (904, 0) in want
    assert got.count() == len(want)
    few = leaked_passages(d, t, shingles=200)  # items in several blocks
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in got.collect()}
    assert leaked_passages(d.limit(0), t).count() == 0 and leaked_passages(d, t.limit(0)).count() == 0


def test_mix_meets_shares_within_repeats(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["big"] * 8 + [" Small-One", "small_one", "tiny"]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60)))) for i in range(1500)]
    docs += [(9000, None, "x"), (9001, "other", "x"), (9002, "big", None), (9003, "big", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.3, 4), ("tiny", 0.15, 5), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    draws, report = mix_sources(d, t)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small_one", "tiny", "none", "other", None}
    for s, share in (("big", 0.5), ("small_one", 0.3), ("tiny", 0.15)):
        assert r[s].actual_share == pytest.approx(share / 0.95, abs=0.01)
    caps = {"big": 1, "small_one": 4, "tiny": 5}
    most = {x.source: x.m for x in draws.groupBy("source").agg(F.max("n_copies").alias("m")).collect()}
    assert all(most[s] <= caps[s] for s in caps)
    again = {(x.doc_id, x.n_copies) for x in mix_sources(d.repartition(3), t, partitions=5)[0].collect()}
    assert again == {(x.doc_id, x.n_copies) for x in draws.collect()}
    big = {x.source: x for x in mix_sources(d, t, total_tokens=10**7)[1].collect()}
    assert big["tiny"].copies == 5 and big["big"].copies == 1
    assert mix_sources(d.limit(0), t)[0].count() == 0


SOUND = ["Même problème ici depuis l’été, côté étang.", "Der Schwellenwert müsste höher sein, sonst gäbe es Fehler.", "Попробуйте уменьшить порог и проверить ещё раз.", "録音が30分で止まります。夜明け前の声です。", "It’s 5 °C – “fine”…", "NÃO HÁ SOLUÇÃO, ATENÇÃO", "├── a\n│   └── b", "plain", "", "R&D &amp; more"]


def test_garbled_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(SOUND * 30)] + [(700, None)]
    n, want = 1000, {}
    for t in SOUND[:4]:
        for meant, read in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251")):
            try:
                bad = t.encode(meant).decode(read)
            except UnicodeDecodeError:
                continue
            rows.append((n, bad))
            want[n] = t
            n += 1
    for t, meant, read in ((SOUND[2], "cp1251", "latin-1"), (SOUND[2], "koi8_r", "cp1251"), (SOUND[1], "cp1252", "cp437")):
        rows.append((n, t.encode(meant).decode(read)))
        want[n] = t
        n += 1
    twice = SOUND[1].encode().decode("latin-1").encode().decode("latin-1")
    part = SOUND[1] + " " + SOUND[0].encode().decode("cp1252") + " " + SOUND[1]
    rows += [(n, twice), (n + 1, part), (n + 2, "gr�n"), (n + 3, "Der Wert m&Atilde;&frac14;sste h&Atilde;&para;her sein, sonst g&Atilde;&curren;be es Fehler."), (n + 4, SOUND[0] * 3000)]
    want |= {n: SOUND[1], n + 1: f"{SOUND[1]} {SOUND[0]} {SOUND[1]}", n + 2: "gr�n", n + 3: "Der Wert müsste höher sein, sonst gäbe es Fehler."}
    got = {r.doc_id: r for r in garbled_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(want)
    assert {i: r.restored for i, r in got.items()} == want
    assert not got[n + 2].complete and got[n].complete
    assert garbled_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_of_a_garbled_post_are_found(spark):
    sound = [(i, f"{t} {i}") for i, t in enumerate(SOUND[:7] * 80)]
    for good, meant, read in ((SOUND[1], "utf-8", "latin-1"), (SOUND[0], "utf-8", "cp1252"), (SOUND[2], "cp1251", "koi8_r"), (SOUND[0], "cp1252", "mac_roman")):
        bad = good.encode(meant).decode(read)
        copies = [(1000 + i, bad) for i in range(280)]  # a third of the rows
        got = {r.doc_id: r.restored for r in garbled_texts(spark.createDataFrame(sound + copies, "doc_id long, text string")).collect()}
        assert got == {i: good for i, _ in copies}, (meant, read)
    # copies that differ are as many texts; strict UTF-8 is evidence of its own
    bad = SOUND[1].encode().decode("latin-1")
    near = [(1000 + i, f"{bad} #{i}") for i in range(280)]
    got = {r.doc_id: r.restored for r in garbled_texts(spark.createDataFrame(sound + near, "doc_id long, text string")).collect()}
    assert got == {i: f"{SOUND[1]} #{i - 1000}" for i, _ in near}


def test_sound_text_is_not_strict_utf8():
    from fieldchirp.llm.garbled import _legacies

    for t in [*SOUND, "à\u00a0«\u00a0là\u00a0» à\u00a0«\u00a0là\u00a0»", "СССР» и СССР…", "┌──┬──┐\n│ a│ b│\n└──┴──┘"]:
        assert not any(x.is_utf8(t) for x in _legacies().values()), t


def test_escaped_garbling_beside_other_entities(spark):
    good = "Der Wert müsste höher sein, sonst gäbe es Fehler."
    once = "Der Wert m&Atilde;&frac14;sste h&Atilde;&para;her sein, sonst g&Atilde;&curren;be es Fehler."
    twice = once.replace("&", "&amp;")
    rows = [(i, t) for i, t in enumerate(SOUND * 30)] + [(1000, f"{once} &amp;lt;b&amp;gt;"), (1001, twice), (1002, "a &amp;lt; b &amp;amp;lt; c")]
    got = {r.doc_id: (r.restored, r.encodings) for r in garbled_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1000, 1001}
    assert got[1000][0] == f"{good} &lt;b&gt;" and got[1001][0] == good
    assert got[1000][1][:2] == ["html", "utf-8<cp1252"] and got[1001][1][:2] == ["html", "html"]


def test_recall_does_not_depend_on_how_much_is_garbled():
    """Every share of the corpus, up to all of it, garbled alike."""
    from fieldchirp.llm.garbled import Costs, _sound_part, features, repair

    posts = {
        "ru": ["Попробуйте уменьшить порог до {} и проверить ещё раз.", "Микрофон {} стоял у болота всю ночь и намок.", "Запись обрывается через {} минут, хотя карта пустая."],
        "fr": ["Même problème ici depuis {} jours, côté étang.", "Le niveau {} a été réglé trop élevé à la création.", "Après {} essais, la fenêtre était déjà fermée."],
    }
    for lang, meant, read in (("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("fr", "cp1252", "cp437"), ("fr", "cp1252", "mac_roman"), ("fr", "utf-8", "cp1252")):
        for share in (0.01, 0.03, 0.1, 0.3, 1.0):
            good = [posts[k][i % 3].format(i) for k in posts for i in range(200)]
            rng = random.Random(share)
            hit = {i for i, t in enumerate(good) if (t[0] > "Ѐ") == (lang == "ru") and rng.random() < max(share, 0.02)}
            texts = [t.encode(meant).decode(read) if i in hit else t for i, t in enumerate(good)]
            counts = {}
            for t in texts:
                for f in set(features(_sound_part(t))):
                    counts[f] = counts.get(f, 0) + 1
            costs = Costs(counts)
            got = {i: repair(t, costs) for i, t in enumerate(texts)}
            found = {i for i, r in got.items() if r[1]}
            assert len(found & hit) >= 0.9 * len(hit) and len(found - hit) <= 0.1 * len(found), (meant, read, share)
            # with no sound Russian at all, one letter in a text may be taken for its neighbour's in a like encoding
            assert share == 1 or sum(got[i][0] == good[i] for i in hit) >= 0.9 * len(hit), (meant, read, share)
