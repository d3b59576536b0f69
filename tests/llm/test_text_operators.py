import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialframe.llm import decontaminate as dc
from trialframe.llm import licenses, quality, toxicity
from trialframe.llm.fit import fit_logistic, predict


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


# -- decontamination


def brute_overlap(doc, item, least=13, percent=80):
    """Longest run over all alignments, by trying all starts and ends."""
    d, t = words(doc), words(item)
    best = 0
    for shift in range(-len(t) + 1, len(d)):
        low, high = max(0, shift), min(len(d), shift + len(t))
        eq = [d[i] == t[i - shift] for i in range(low, high)]
        for a in range(len(eq)):
            if eq[a]:
                for b in range(len(eq), a, -1):
                    if b - a <= best:
                        break
                    if eq[b - 1] and 100 * sum(eq[a:b]) >= percent * (b - a):
                        best = max(best, b - a)
                        break
    return best if best and best >= min(least, len(t)) else 0


def test_overlaps_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(6, 50)))) for k in range(25)]
    docs = []
    for i in range(80):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if i % 2:
            p = r.choice(items)[1].split()
            for _ in range(i % 5):
                p[r.randrange(len(p))] = "swapped"
            at = r.randint(0, len(w))
            w[at:at] = p
        docs.append((i, " ".join(w).capitalize().replace("v1", "V1")))
    rows = dc.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]): x["n_words"] for x in rows}
    want = {(i, k): n for i, t in docs for k, u in items if (n := brute_overlap(t, u))}
    assert got == want


def test_one_substitution_is_always_found(spark):
    item = " ".join(f"t{i}" for i in range(15))
    docs = [(i, "x y z " + " ".join("other" if k == i else f"T{k}," for k in range(15)) + " tail end") for i in range(15)]
    got = dc.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), least_words=13).collect()
    assert {r["doc_id"] for r in got} == set(range(15))


def replaced(w, places):
    return ["other" if k in places else x for k, x in enumerate(w)]


def test_every_overlap_of_the_threshold_is_found(spark):
    # all choices of replaced inner words, in items of 5 to 17 words
    items, docs, want = [], [], set()
    for n in (*range(5, 14), 15, 16, 17):
        w = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        for k in range(n // 5 + 1):
            for places in combinations(range(1, n - 1), k):
                want.add((len(docs), n, n))
                docs.append((len(docs), " ".join(["before", *replaced(w, places), "after"])))
        docs.append((len(docs), " ".join(replaced(w, range(1, n // 5 + 2)))))  # one too many
    got = dc.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    whole = {(r["doc_id"], r["item_id"], r["n_words"]) for r in got}
    assert want <= whole
    assert {x for x in whole if x not in want} <= {(i, k, n) for i, k, n in whole if n < k}  # shorter runs of long items


def test_no_misses_against_brute_force(spark):
    r = random.Random(10)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 7, 9, 11, 12, 13, 15, 20, 24])))) for k in range(40)]
    docs = []
    for i in range(400):
        p = r.choice(items)[1].split()
        p = replaced(p, r.sample(range(len(p)), (len(p) + 2) // 5))
        docs.append((i, " ".join([*r.choices(vocabulary, k=20), *p, *r.choices(vocabulary, k=20)])))
    for least, percent in ((13, 80), (10, 60)):
        got = dc.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least_words=least, percent=percent).collect()
        assert {(x["doc_id"], x["item_id"]): x["n_words"] for x in got} == {(i, k): n for i, t in docs for k, u in items if (n := brute_overlap(t, u, least, percent))}


def test_masks_are_complete():
    assert dc.complete(dc.MASKS, 13, 80) and not dc.complete(("11011101", "1101011011", "111001010111"), 13, 80)
    for n in range(13, 19):
        for places in combinations(range(1, n - 1), n // 5):
            run = "".join("01"[k not in places] for k in range(n))
            assert any(all(m == "0" or c == "1" for m, c in zip(mask, run[at:])) for mask in dc.MASKS for at in range(n - len(mask) + 1)), run


def test_decontamination_edges(spark, monkeypatch):
    schema = "doc_id long, text string, item_id string, n_words int"
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (2, None, None, None), (3, "", "b", 2), (None, text, "c", 3), (4, "word " * 100_000, "d", 4), (5, text[:30], "e", 5)], schema)
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (10, "four words are short"), (11, "two three")], "item_id long, text string")
    for words in (dc.BLOCK_WORDS, 10):  # one block and several
        monkeypatch.setattr(dc, "BLOCK_WORDS", words)
        rows = dc.benchmark_overlaps(docs, items).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 7), (None, 7), (1, 11), (None, 11), (5, 11)}
        assert {(r["doc_id"], r["item_id"]) for r in dc.benchmark_overlaps(docs, items, short=5).collect()} == {(1, 7), (None, 7)}
        kept = dc.decontaminate(docs, items, short=5)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [2, 3, 4, 5]
        empty = spark.createDataFrame([], schema)
        assert dc.decontaminate(empty, items).count() == 0 and dc.decontaminate(docs, items.where("false")).count() == 7


def test_equal_words_need_little():
    # 299 million pairs of equal windows
    h, ends = dc.plain_words(pa.array(["word " * 150_000, "word " * 900 + " ".join(f"u{i}" for i in range(1_100))], pa.large_string()))
    block, row = dc._Block([(1, h[:2_000]), (2, h[150_000:])], 1, 13, 80), np.repeat([0, 1], np.diff(ends))
    assert sum(len(here) for here, _ in block.hits(h, row)) < 1_000_000
    short = np.concatenate((h[:20_000], h[150_000:]))
    got = dc._overlaps(block, short, np.array([0, 20_000, 22_000]), 13, 80)
    assert got[0, 0] == (2_000, 0, 0, 2_000) and got[1, 1] == (2_000, 0, 0, 2_000)
    assert got[0, 1][:2] == (900, 0) and got[1, 0][0] == 900


def test_overlaps_of_repeating_words_against_brute_force():
    r = random.Random(6)
    for _ in range(150):
        texts = [" ".join(r.choice("ab") if r.random() < 0.9 else "c" for _ in range(r.randint(0, 60))) for _ in range(4)]
        items = [" ".join(r.choice("ab") if r.random() < 0.9 else "c" for _ in range(r.randint(1, 30))) for _ in range(3)]
        h, ends = dc.plain_words(pa.array(texts, pa.large_string()))
        held = dc._Block([(k, dc.plain_words(pa.array([u], pa.large_string()))[0]) for k, u in enumerate(items)], 1, 13, 80)
        got = {k: v[0] for k, v in dc._overlaps(held, h, ends, 13, 80).items()}
        assert got == {(i, k): n for i, t in enumerate(texts) for k, u in enumerate(items) if (n := brute_overlap(t, u))}


def test_decontamination_query_against_brute_force(spark):
    from trialframe.llm.queries import op10_benchmark_decontamination

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in op10_benchmark_decontamination(spark, sf).collect()}
    want = {}
    for i, d in docs.items():
        number = {w: k for k, w in enumerate({w for x in items.values() for w in x})}
        held = np.array([number.get(w, -1) for w in d])
        for k, t in items.items():
            own = np.array([number[w] for w in t])
            least = min(13, len(own))
            for shift in range(-len(own) + 1, len(held)):  # every alignment, every start, no seeds
                low, high = max(0, shift), min(len(held), shift + len(own))
                equal = held[low:high] == own[low - shift : high - shift]
                if equal.sum() * 100 >= 80 * least:
                    run = np.concatenate(([0], np.cumsum(np.where(equal, 20, -80))))
                    for a in np.flatnonzero(equal):
                        far = [e for e in np.flatnonzero(equal) if e >= a and run[e + 1] >= run[a]]
                        if far and far[-1] + 1 - a >= least:
                            want[i, k] = max(want.get((i, k), 0), int(far[-1] + 1 - a))
    assert got == want


# -- licences


def brute_licence(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))


TEXTS = [None, "", "MIT License", "the mit\nlicense, mit-license; MIT  LICENSE", "mit", "license mit", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "gnu general-public\x00license é mit licenseé", "word " * 50_000 + "mit license", "Licensed under CC BY-NC 4.0.", "general public licence", "K mit licenſe ©mit license"]


def test_licences_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, "MIT License", "x"), (None, "mit license", "y")], "doc_id long, text string, labels string")
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licence(TEXTS[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    by = {r["doc_id"]: r for r in got}
    assert "apache-2.0" in by[6]["labels"] and "gpl-3.0" in by[7]["labels"] and by[10]["labels"] == "cc-by-nc-4.0" and by[10]["score"] == 1
    assert licenses.license_scan(docs.where("false")).count() == 0


def brute_labels(text):
    """Each template at each place of the file: at least two words in place, its mandatory phrases around it."""
    w, found = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower()), {}
    for label, template, keys in licenses.TEMPLATES:
        t = template.split()
        for shift in range(-len(t), len(w) + 1):
            votes = sum(0 <= shift + i < len(w) and w[shift + i] == x for i, x in enumerate(t))
            near = w[max(0, shift - licenses.SLACK) : shift + len(t) + licenses.SLACK] if shift + len(t) + licenses.SLACK > 0 else []
            if votes >= min(2, len(t)) and all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in (key.split() for key in keys)):
                found[label] = max(found.get(label, 0.0), votes / len(t))
    return found


def test_licences_in_long_texts_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = sorted({x for _, t, _ in licenses.TEMPLATES for x in t.split()})
    notices = ["licensed under the GNU General Public License version 3", "licensed under the GNU General Public License version 2", "licensed under CC BY 4.0", "released under the MIT license", "CC BY-NC 4.0", "CC BY-SA 4.0", "licensed under the GNU Lesser General Public License", *(t for _, t, _ in licenses.TEMPLATES)]
    texts = []
    for k in range(40):
        filler = rng.sample(vocabulary, len(vocabulary)) if k % 2 else [rng.choice(["plain", "prose", *vocabulary]) for _ in range(300)]
        for notice in rng.sample(notices, 1 + k % 4):
            words = notice.split()
            if k % 5 == 4:
                words[rng.randrange(len(words))] = "other"
            at = rng.randrange(len(filler) + 1)
            filler[at:at] = words
        texts.append(" ".join(filler[k % 7 :]))
    texts += [" ".join([*vocabulary, n]) for n in notices] + ["mit license " * 3_000]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want, (*_, base) = brute_labels(text), brute_licence(text)
        assert got[i]["labels"] == ",".join(sorted({*want, *filter(None, base.split(","))})), text
        assert got[i]["score"] == pytest.approx(max([0.0, *([0.5] if base else []), *want.values()])), text


# -- toxicity


def test_folding_undoes_disguises():
    for t in ("Idiot", "1d10t", "іdiоt", "ＩＤＩＯＴ", "i​diot", "id!ot", "IDIOT!!"):
        assert toxicity.fold(t) == " idiot "
    assert toxicity.fold("L0ser c1own $tupid tra$h") == toxicity.fold("loser clown stupid trash").replace("stupid", "tupid")
    assert toxicity.fold("") == "  " and toxicity.fold("$$$ ###") == "  "


def toxic_docs(n=400):
    r = random.Random(1)
    plain = [a + b for a in "bcdfghkmnprstv" for b in ("ara", "elo", "imu", "ona")]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(("grumbald", "snorfle", "gr0mbald".replace("0", "u")))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_is_learned_and_ignores_held_out_labels(spark):
    docs, labels = toxic_docs()
    d = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs], "doc_id long, text string, score double, _y string")
    good = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(d, good)
    scored = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d, lexicon, score="score").collect()}
    assert sum((scored[i] >= 0.7) == bool(y) for i, y in labels) >= 0.97 * len(labels)
    # other labels of the held-out third change nothing
    from pyspark.sql import functions as F

    other = good.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn_lexicon(d, other).weights == lexicon.weights
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(d, toxicity.learn_lexicon(d, other), score="score").collect()} == scored
    disguised = spark.createDataFrame([(1, "bara GRUMBA1D celo"), (2, None), (3, ""), (4, "bara celo"), (5, "bara " * 200_000)], "doc_id long, text string")
    s = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity_scores(disguised, lexicon).collect()}
    assert s[1] > 0.7 and all(s[k] < 0.7 for k in (2, 3, 4, 5))


def test_exceptions_and_empty_lexicon(spark):
    lexicon = toxicity.Lexicon({" trash ": 3.0}, {" trash can "})
    assert lexicon.matches(toxicity.fold("the trash can")) == {} and len(lexicon.matches(toxicity.fold("trash trash can trash"))) == 2
    none = spark.createDataFrame([], "doc_id long, toxic int")
    d = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    empty = toxicity.learn_lexicon(d, none)
    assert not empty.weights and {r["toxicity"] for r in toxicity.toxicity_scores(d, empty).collect()} == {0.5}
    assert toxicity.toxicity_scores(d.where("false"), empty).count() == 0


def brute_toxicity(rows):
    """{id: score} by plain counting, without Spark or an automaton; rows are (id, text, label or None)."""
    fit = [(t or "", y) for i, t, y in rows if y is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    used = [(set(toxicity._used_terms(toxicity.fold(t))), y) for t, y in fit]
    toxic, clean = sum(y for _, y in fit), sum(1 - y for _, y in fit)
    a, b = (Counter(x for terms, y in used if y == k for x in terms) for k in (1, 0))
    tried = [x for x in a if a[x] >= toxicity.LEAST_DOCS]
    share = (toxic + 0.5) / (toxic + clean + 1)
    best = []
    for x in tried:
        surprise = a[x] * math.log(a[x] / ((a[x] + b[x]) * share)) + (b[x] * math.log(b[x] / ((a[x] + b[x]) * (1 - share))) if b[x] else 0)
        ratio = ((a[x] + 0.5) / (toxic + 1)) / ((b[x] + 0.5) / (clean + 1))
        if ratio >= toxicity.LEAST_RATIO and surprise >= math.log(max(2, len(tried))):
            best.append((x, a[x], math.log(ratio)))
    weights = toxicity.choose_entries(sorted(best, key=lambda r: (-r[1] * r[2], -len(r[0]), r[0])))

    def found(text, spared):
        f, out, at = toxicity.fold(text), [], 0
        for w in f.split():
            at = f.index(f" {w} ", at)
            fits = [weights[e] for e in (f" {w} ", *(f" {w}"[:k] for k in range(2, len(w) + 2))) if e in weights]
            if fits and not any(f.startswith(p, k) and k <= at < k + len(p) - 1 for p in spared for k in range(max(0, at - 60), at + 1)):
                out.append((at, max(fits)))
            at += 1
        return f, out

    around = Counter(), Counter()
    for t, y in fit:
        f, hits = found(t, ())
        near = set()
        for at, _ in hits:
            words = f[at:].split()
            near |= {f" {words[0]} ", f" {' '.join(words[:2])} "} | ({f" {f[:at].split()[-1]} {words[0]} "} if f[:at].split() else set())
        around[y].update(near)
    spared = {x for x, n in around[0].items() if n >= 2 and around[1][x] * (clean + 1) <= n * (toxic + 1)} - set(weights)

    def features(text):
        f, hits = found(text or "", spared)
        total, n = sum(w for _, w in hits), max(1, len(f.split()))
        return [1.0, math.log(max(100 * len(hits) / n, 0.01)), total / len(hits), math.log1p(len(hits)), min(total, 6.0)] if hits else [0.0] * 5

    model = fit_logistic(np.array([features(t) for t, _ in fit]), np.array([float(y) for _, y in fit]))
    return {i: float(predict(model, np.array([features(t)]))[0]) for i, t, _ in rows}, weights, spared


def test_toxicity_query_against_brute_force(spark):
    from trialframe.llm.queries import op9_toxicity

    sf = "/root/testdata/sf0.001"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["doc_id"], r["text"], label.get(r["doc_id"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _, _ = brute_toxicity(rows)
    got = {r["doc_id"]: r for r in op9_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r["score"] == pytest.approx(want[i], abs=1e-6) and r["predicted"] == int(want[i] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_learned_entries_against_brute_force(spark):
    docs, labels = toxic_docs(300)
    docs = [(i, f"{t} grumbald fish" if i % 40 == 3 else t) for i, t in docs]  # a harmless phrase
    label = dict(labels)
    want, weights, spared = brute_toxicity([(i, t, label[i]) for i, t in docs])
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon.weights == pytest.approx(weights) and lexicon.exceptions == spared and any("fish" in p for p in spared)
    got = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), lexicon).collect()
    assert {r["doc_id"]: r["toxicity"] for r in got} == pytest.approx(want)


ORDINARY = [
    "The disease spread along the path, and traders told more stories of the distant district tradition.",
    "She disguised the pathological studies of mortality; a train passed the trainers on the track.",
    "Die Moral der Geschichte: auf dem Pfad durch die Distanz fuhr ein Zug, achtsam und ehrlich.",
    "Le train passe près de la réunion; la morale de cette histoire réelle est une question de distance.",
    "La enfermedad y la distancia son parte de la historia moral del tren, bonita y tranquila.",
]


@pytest.mark.parametrize("sf,recall", [("sf0.01", 0.88), ("sf0.1", 0.92)])
def test_held_out_toxicity(spark, sf, recall):
    # some labelled documents hold no insult at all, so no text can tell them; see the README
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", "toxic")
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert all(len(e.strip()) >= 4 and (e.endswith(" ") or len(e) > 5) for e in lexicon.weights)
    rows = toxicity.toxicity_scores(docs.where(toxicity.held_out(F.col("doc_id"))), lexicon).collect()
    hit = [r["toxicity"] >= 0.7 for r in rows if r["toxic"]]
    wrong = [r["toxicity"] >= 0.7 for r in rows if not r["toxic"]]
    assert sum(hit) >= recall * len(hit) and sum(wrong) <= 0.005 * len(wrong)
    plain = spark.createDataFrame(list(enumerate(ORDINARY)), "doc_id long, text string")
    assert all(r["toxicity"] < 0.7 for r in toxicity.toxicity_scores(plain, lexicon).collect())


# -- quality


def test_quality_keeps_good_and_shrinks_sparse_sites(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(40)]
        docs.append((i, " ".join(f"{x}%%%" for x in w) if bad else " ".join(w) + ".", f"s{i % 3}" if i else None, "en", 9.0))
        labels.append((i, int(not bad)))
    d = spark.createDataFrame([*docs, (None, None, None, None, None), (5, "", "lonely", "xx", 1.0)], "doc_id long, text string, source string, lang string, evidence double")
    out = quality.quality_scores(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = out.collect()
    assert len(rows) == 302 and out.columns[:4] == ["doc_id", "text", "source", "lang"]
    good = {i: y for i, y in labels}
    assert all((x["quality_score"] >= 0.5) == bool(good[x["doc_id"]]) for x in rows if x["text"])
    lonely = next(x for x in rows if x["source"] == "lonely")
    assert abs(lonely["path_posterior"] - 0.8) < 0.1  # nothing but the prior
    assert quality.quality_scores(d.where("false"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def brute_quality(rows, prior_rows):
    """{row number: score} by plain loops over (id, text, host, path, label or None)."""
    fit = [r for r in prior_rows if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    texts = lambda rs: pa.array([r[1] or "" for r in rs], pa.large_string())
    p = predict(fit_logistic(quality.text_features(texts(fit)), np.array([float(r[4]) for r in fit])), quality.text_features(texts(rows)))
    prior = (p.sum() + 0.5) / (len(p) + 1)

    def strength(groups, above):
        within = sum(((p[g] - p[g].mean()) ** 2).sum() for g in groups.values()) / max(len(p) - len(groups), 1)
        spread = max(0.0, (sum(len(g) * (p[g].mean() - above[k]) ** 2 for k, g in groups.items()) - len(groups) * max(within, 1e-6)) / len(p))
        return min(1e4, max(2.0, max(within, 1e-6) / max(spread, 1e-9))) if len(groups) > 1 else 100.0

    hosts, paths = {}, {}
    for i, r in enumerate(rows):
        hosts.setdefault(r[2], []).append(i), paths.setdefault((r[2], r[3]), []).append(i)
    k1 = strength(hosts, dict.fromkeys(hosts, prior))
    k2 = strength(paths, {(h, q): (p[hosts[h]].sum() + k1 * prior) / (len(hosts[h]) + k1) for h, q in paths})
    logit = lambda x: math.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    out = {}
    for i, r in enumerate(rows):
        h = (p[[j for j in hosts[r[2]] if j != i]].sum() + k1 * prior) / (len(hosts[r[2]]) - 1 + k1)
        q = (p[[j for j in paths[r[2], r[3]] if j != i]].sum() + k2 * h) / (len(paths[r[2], r[3]]) - 1 + k2)
        out[i] = 1 / (1 + math.exp(-(logit(p[i]) + logit(q) - logit(prior))))
    return out


def test_quality_query_against_brute_force(spark):
    from trialframe.llm.queries import GOOD, op4_quality_classifier

    sf = "/root/testdata/sf0.001"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"], label.get(r["doc_id"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_quality(rows, rows)
    got = {r["doc_id"]: r for r in op4_quality_classifier(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert got[r[0]]["quality_score"] == pytest.approx(want[i], abs=1e-6) and got[r[0]]["keep"] == (want[i] >= GOOD)


def test_a_site_changes_the_decision_of_its_documents(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    bad = lambda share: " ".join(f"{word()}{'%%%' if r.random() < share else ''}" for _ in range(60))
    docs, labels = [], []
    for i in range(400):  # two sites of good documents, one of bad ones
        host = ("good", "fine", "junk")[i % 3]
        docs.append((i, bad(0.9 if host == "junk" else 0.05), host, "en"))
        labels.append((i, int(host != "junk")))
    border = bad(0.45)
    docs += [(1_000, border, "good", "en"), (1_001, border, "junk", "en"), (1_002, border, "sparse", "en"), (1_003, border, "other", "xx")]
    out = {x["doc_id"]: x for x in quality.quality_scores(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert out[1_000]["evidence"] == out[1_001]["evidence"] == out[1_002]["evidence"]
    assert out[1_000]["quality_score"] > out[1_002]["quality_score"] > out[1_001]["quality_score"]
    assert (out[1_000]["quality_score"] >= 0.5) != (out[1_001]["quality_score"] >= 0.5)
    # a site of one document says nothing beyond the prior
    assert out[1_002]["path_posterior"] == pytest.approx(out[1_002]["host_posterior"]) and out[1_002]["quality_score"] == pytest.approx(out[1_002]["evidence"], abs=0.02)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_quality(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = quality.quality_scores(docs, labels, keep=("doc_id",)).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert sum((r["quality_score"] >= 0.5) == bool(r["quality"]) for r in rows) >= 0.95 * len(rows)


def test_clashing_columns_stay(spark):
    rows = [(i, "some plain words here", "s", "en", i, f"h{i}", 0.25, 1, 2) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int, _host string, site_path double, host int, S int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(d, labels)
    assert out.columns[:9] == d.columns and sorted(tuple(r)[:9] for r in out.collect()) == rows
    tox = toxicity.toxicity_scores(d.withColumn("y", F.lit(1)).withColumn("term", F.lit("t")), toxicity.learn_lexicon(d.withColumn("_y", F.lit(3)), labels))
    assert [tuple(r)[:9] for r in sorted(tox.collect())] == rows


def test_features_have_one_row_a_text():
    texts = pa.array(["", "a", "A!|9é", "x " * 10_000], pa.large_string())
    x = quality.text_features(texts)
    assert x.shape[0] == 4 and np.isfinite(x).all()
    assert quality.text_features(pa.array([], pa.large_string())).shape[0] == 0


def test_logistic_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 20)
    y = (x[:, 0] > 1.5).astype(float)
    assert ((predict(fit_logistic(x, y), x) > 0.5) == (y == 1)).all()


@pytest.mark.parametrize("y", [np.zeros(3), np.ones(3)])
def test_logistic_of_one_class_is_the_base_rate(y):
    p = predict(fit_logistic(np.zeros((3, 2)), y), np.zeros((1, 2)))
    assert np.allclose(p, (y.sum() + 0.5) / 4)


def test_fits_take_one_row_of_a_repeated_id(spark, monkeypatch):
    rows = [(i, f"some text number {i}") for i in range(12)] + [(0, f"another row {i}") for i in range(300)] + [(3, "another row 1")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    ids = labels.where(~toxicity.held_out(F.col("doc_id"))).count()
    fitted = []
    for module, learn in ((quality, quality.learn_quality), (toxicity, toxicity.learn_lexicon)):
        monkeypatch.setattr(module, "fit_logistic", lambda x, y: fitted.append(len(x)) or fit_logistic(x, y))
        learn(docs, labels)
    assert 0 < ids < 12 and fitted == [ids, ids]
