"""Hard negatives, class-based scores and fill-in-the-middle, each against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from nudgetrail.llm import brown, fill_middle, hard_negatives
from nudgetrail.llm.common import Stages
from nudgetrail.llm.words import digest_spans, words_of
from pyspark.sql import functions as F

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
WORD = re.compile("[^\x20\x09-\x0d]+")


def _filled(text, doc_id):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", [1, 2, 7, 4096])
def test_frames_of_any_size_give_the_same_cuts(units):
    rng = random.Random(units)
    for doc_id in [None, *range(300)]:
        parts = rng.choices("a Bc é \n 中 \U0001f44d < P> S 1 \x00".split(" "), k=rng.randrange(50))
        text = "".join(parts)
        frames = fill_middle.Frames.of(text.encode(), units)
        marked = any(m in text for m in ("<P>", "<S>", "<M>"))
        got = fill_middle.fill(frames, doc_id, marked)
        output = b"".join(got.parts)
        head = (got.units, got.form, got.prefix_chars, got.middle_chars)
        assert (*head, output.decode()) == _filled(text, doc_id)
        assert fill_middle.restore(output, got.form).decode() == text
        assert b"".join(frames.frame(i) for i in range(len(frames))).decode() == text


def test_fill_in_the_middle_of_odd_rows(spark, docs, no_docs, tmp_path):
    extra = [(12, "a <P> b", "en", "a", 0, "x", 1), (None, "no id", "en", "a", 0, "x", 1)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    fill_middle.write_frames(rows, f"{tmp_path}/frames", units=100)
    texts = fill_middle.read_filled(spark, f"{tmp_path}/frames").collect()
    digests = fill_middle.read_digests(spark, f"{tmp_path}/frames").collect()
    want = [(r.doc_id, *_filled(r.text or "", r.doc_id)) for r in rows.collect()]
    assert Counter(map(tuple, texts)) == Counter(want)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    plain = {r.doc_id: r.text or "" for r in rows.collect()}
    assert Counter(map(tuple, digests)) == Counter(
        (*w[:-1], sha(w[-1]), sha(plain[w[0]])) for w in want
    )
    fill_middle.write_frames(no_docs, f"{tmp_path}/none")
    assert fill_middle.read_digests(spark, f"{tmp_path}/none").count() == 0


def _mined(rows):
    """Plain hard negatives of (vec_id, label, vector) rows; anchors have a vec_id divisible by 5."""

    def usable(r):
        if any(x is None for x in r) or any(x is None or not math.isfinite(x * 256) for x in r[2]):
            return None
        return r[0], r[1], [math.floor(256 * x) for x in r[2]]

    used = [x for x in map(usable, rows) if x]

    def score(a, b):
        return max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))

    out = []
    for a in used:
        if a[0] % 5:
            continue
        others = [(score(a[2], b[2]), b) for b in used if b[0] != a[0] and len(b[2]) == len(a[2])]
        others.sort(key=lambda x: (-x[0], x[1][0]))
        for p, pos in [x for x in others if x[1][1] == a[1]][:5]:
            inside = [x for x in others if x[1][1] != a[1] and 30 * p <= 100 * x[0] <= 90 * p]
            for rank, (s, neg) in enumerate(inside[:10], 1):
                out.append((a[0], pos[0], rank, neg[0], p, s))
    return out


@pytest.mark.parametrize("most_vectors, most_anchors", [(1 << 15, 1 << 12), (40, 3)])
def test_hard_negatives_are_those_of_brute_force(spark, most_vectors, most_anchors):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = []
    for i in range(260):
        v = centre[i % 6] * rng.uniform(0.2, 3) + rng.normal(size=8) * rng.choice([0.01, 0.4])
        rows.append((i, int(rng.integers(0, 3)), [float(x) for x in v]))
    same = rows[10][2]
    rows += [(300 + i, i % 2, same) for i in range(30)]  # ties
    rows += [(400, 0, rows[0][2]), (401, 0, None), (402, None, rows[1][2]), (None, 0, rows[1][2])]
    rows += [(403, 1, [None] * 8), (404, 1, [math.nan] * 8), (405, 1, [math.inf] * 8)]
    rows += [(410, 0, [0.0] * 8), (411, 1, [0.0] * 8), (412, 1, [1e306] * 8), (415, 2, [])]
    rows += [(420 + i, i % 2, [3e9 + i * 1e7] * 8) for i in range(6)]  # beyond double precision
    rows += [(430 + i, i % 2, [1e200, 1e-200] * 4) for i in range(6)]  # beyond a long
    rows += [(440 + i, i % 3, [float(x) for x in rng.normal(size=3)]) for i in range(40)]  # shorter
    schema = "vec_id long, label int, vector array<double>, row long, rank int, group string"
    df = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], schema).repartition(3)
    anchor = F.col("vec_id") % 5 == 0

    def mined(df):
        stages = Stages(spark, "test")
        sizes = {"most_vectors": most_vectors, "most_anchors": most_anchors}
        return hard_negatives.hard_negatives(df, anchor, stages, **sizes)

    want = _mined(rows)
    assert len(want) > 500
    assert Counter(map(tuple, mined(df).collect())) == Counter(want)
    assert mined(df.limit(0)).count() == 0


def test_score_bounds_hold_and_leave_vectors_out():
    rng = np.random.default_rng(1)
    q = np.floor(256 * (np.repeat(rng.normal(size=(5, 16)), 80, axis=0) + rng.normal(size=(400, 16)) / 20))
    angle, norm = hard_negatives.angles_to(hard_negatives.directions(q), q)
    out = 0
    for a in range(0, 400, 7):
        low, high = hard_negatives.score_bounds(angle[a], norm[a], angle.T, angle.T, norm, norm)
        exact = q @ q[a]
        assert (low <= exact).all() and (exact <= high).all()
        out += (high < 0.5 * norm[a] ** 2).sum()
    assert out > 400 * 57 // 2


def test_words_of_a_regular_build_keep_their_keys_apart():
    bits = [0]
    while len(bits) < 8192:
        bits += [1 - b for b in bits]
    for n in (5, 63, 64, 65, 512, 1024, 8192):
        a = bytes(97 + b for b in bits[:n])
        pair = [a, bytes(195 - b for b in a), a + b"a", a[:-1], b"x " + a]
        keys = words_of(pair, digest_spans).hash.tolist()
        assert len(set(keys[:4])) == 4 and keys[5] == keys[0]


def test_best_move_gains_what_it_says():
    rng = np.random.default_rng(2)
    size, n = 200, brown.CLASSES
    pairs = np.zeros((size, size))
    for a, b in rng.integers(0, size, (3000, 2)):
        pairs[a, b] += rng.integers(1, 30)
    classes = 1 + rng.integers(0, n - 1, size)

    def counted(classes):
        out = np.zeros((n, n))
        np.add.at(out, (classes[:, None].repeat(size, 1), classes[None].repeat(size, 0)), pairs)
        return out

    now = counted(classes)
    for w in range(0, size, 9):
        rest = np.arange(size) != w
        left = np.bincount(classes[rest], pairs[rest, w], n)
        right = np.bincount(classes[rest], pairs[w, rest], n)
        to, gain = brown.best_move(now, left, right, pairs[w, w], classes[w])
        gains = []
        for c in range(1, n):
            moved = classes.copy()
            moved[w] = c
            gains.append(brown.likelihood(counted(moved)) - brown.likelihood(now))
        assert math.isclose(gain, max(gains), abs_tol=1e-6)
        assert math.isclose(gains[to - 1], gain, abs_tol=1e-6)


@pytest.fixture(scope="module")
def scored_rows():
    rng = random.Random(4)
    nouns, verbs, odd = ([f"{k}{i}" for i in range(40)] for k in ("noun", "Verb", "odd"))
    texts = []
    for _ in range(300):
        words = [w for _ in range(rng.randrange(1, 40)) for w in (rng.choice(nouns), rng.choice(verbs))]
        texts.append(" ".join(words) + rng.choice(["", "\n", " " + rng.choice(odd), f" once{rng.random()}"]))
    texts += [None, "", " \t\n", "été 中 \U0001f44d", "noun1 " * 3000, texts[0]]
    return [(i if i != 7 else None, t, "en", 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], "en", 1, 2)]


def test_class_scores_against_plain_counts(spark, scored_rows):
    docs = spark.createDataFrame(scored_rows, "doc_id long, text string, lang string, block long, n long")
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1
    got = brown.class_scores(docs.repartition(3), train, Stages(spark, "test"), 2.0**-9, 2000).collect()

    def tokens(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]

    count = Counter()
    for i, t, *_ in scored_rows:
        if (i or 0) % 5 != 1:
            count.update(tokens(t))
    total, types = sum(count.values()), len(count)

    def expected(row):
        w = tokens(row[1])
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        return (row[0], (row[0] or 0) % 5 != 1, len(w), sum(count[x] > 0 for x in w), total, round(base, 6))

    found = Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert found == Counter(map(expected, scored_rows))
    held = [r for r in got if not r.train]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_probabilities_after_any_word_sum_to_one(spark, scored_rows, monkeypatch):
    """Over all known words and the unknown one, whatever stands before."""
    held = {}
    kept = brown._model

    def model(core, classes, transitions, dictionary, *rest):
        held["model"] = kept(core, classes, transitions, dictionary, *rest)
        held["rare"] = dictionary.where("first").toPandas().sort_values("key", key=lambda k: k.to_numpy().view("u8"))
        return held["model"]

    monkeypatch.setattr(brown, "_model", model)
    docs = spark.createDataFrame(scored_rows, "doc_id long, text string, lang string, block long, n long")
    brown.class_scores(docs, F.col("doc_id") % 2 == 0, Stages(spark, "test"), 2.0**-9, 2000)
    m, rare = held["model"], held["rare"]
    extra = (rare["key"].to_numpy().view("u8"), rare["n"].to_numpy(), rare["class"].to_numpy())
    words = np.concatenate([m.core.keys, extra[0], np.array([12345], dtype="u8")])
    assert len(words) == m.words + 1
    for before in words[[0, 5, len(m.core.keys), len(words) - 1]].tolist():
        after = [m.token_scores(np.array([before, w], dtype="u8"), extra)[1][1] for w in words]
        assert math.isclose(sum(10**x for x in after), 1, rel_tol=1e-9)


def test_class_scores_of_nothing_and_of_no_training_text(spark, docs, no_docs):
    assert brown.class_scores(no_docs, F.lit(True), Stages(spark, "test")).count() == 0
    rows = docs.where("doc_id < 10")
    got = brown.class_scores(rows, F.lit(None).cast("boolean"), Stages(spark, "test")).collect()
    assert len(got) == 9
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    empty = rows.where("doc_id in (6, 7, 8)")
    got = brown.class_scores(empty, F.lit(True), Stages(spark, "test")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 1, 3)}
    assert all(math.isfinite(r.score) for r in got)
