import hashlib
import math

import numpy as np
import pytest
from llm_rows import PASSAGE
from nudgetrail.llm import bagminhash, hnsw, order_minhash, substrings
from nudgetrail.llm.common import Stages
from nudgetrail.llm.components import components
from nudgetrail.llm.words import U64, mix


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 6, 200) + (rng.random(200) < 0.05) * 70
    b = np.maximum(0, a + rng.integers(-1, 2, 200))
    name = mix(np.arange(200, dtype=U64))
    owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    names = np.concatenate([name[a > 0], name[b > 0]])
    sign = bagminhash.bag_signatures(owner, names, np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - exact) < 0.03


def test_classes_of_near_duplicates(docs, no_docs):
    found = {r.doc_id: (r.class_id, r.kept) for r in bagminhash.near_duplicates(docs).collect()}
    assert found[1] == (1, True) and found[2] == (1, False) and found[3] == (1, False)
    assert found[7] == (6, False)  # null and empty are equal texts
    assert all(found[d] == (d, True) for d in (4, 5, 6, 8, 9, 10, 11))
    assert bagminhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    stages = Stages(spark, "test")
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), stages).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long"), stages, "none").count() == 0


def test_a_spliced_passage_is_found_and_cut(spark, docs, no_docs):
    rows = docs.where("doc_id in (4, 5, 6, 7, 9, 11)")
    found = substrings.repeated_paragraphs(rows, Stages(spark, "test")).collect()
    assert {(r.doc_id, r.removed) for r in found} == {(4, False), (5, True)}
    left = {r.doc_id: r for r in substrings.without_repeats(rows).collect()}
    text = {r.doc_id: r.text for r in rows.collect()}
    assert all(left[d].text == text[d] for d in (4, 6, 7, 9, 11))
    assert PASSAGE not in left[5].text and left[5].n_chars == len(left[5].text)
    assert substrings.without_repeats(no_docs).columns == no_docs.columns
    assert substrings.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("shift", range(0, 27, 13))
def test_any_passage_of_51_words_shares_a_paragraph(shift):
    words = [f"p{i}" for i in range(51)]
    a = [f"a{i}" for i in range(40 + shift)] + words + ["x"] * 9
    b = [f"b{i}" for i in range(77)] + words + [f"y{i}" for i in range(30)]

    def units(text):
        w = substrings.words_of([" ".join(text).encode()])
        at = np.arange(len(text) - substrings.PARAGRAPH + 1)
        owner = np.zeros(len(at), dtype=int)
        at = at[substrings._anchors(substrings._runs(w.hash, at, substrings.SHINGLE), owner)]
        return {tuple(text[i : i + substrings.PARAGRAPH]) for i in at}

    assert units(a) & units(b)


def test_fingerprints(docs, no_docs):
    got = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    order = sorted(docs.collect(), key=lambda r: (-r.doc_id, r.text or ""))
    for r, after in zip(order, order[1:] + order[:1]):
        if r.doc_id == 11 and after.doc_id == 11:
            continue
        text = order_minhash.edited(r.text or "", after.text or "")
        g = got[r.doc_id]
        assert g.n_chars == len(r.text or "")
        assert g.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint
    assert got[11].near_edited > 0.1 > got[4].near_next
    assert order_minhash.fingerprints(docs).count() == docs.count()
    assert order_minhash.fingerprints(no_docs).count() == 0


def test_vectors_link_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(160, 16))
    base[60:130] = base[60] + 0.05 * rng.normal(size=(70, 16))
    base[130:140] = base[3]
    rows = [(i, v.tolist(), i % 2 if i < 60 else 0) for i, v in enumerate(base)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0),
             (503, base[3].tolist(), None), (504, base[3].tolist()[:8], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for shard in (2048, 40):
        got = {r.vec_id: r for r in hnsw.linked_vectors(table, shard).collect()}
        unit = base / np.linalg.norm(base, axis=1, keepdims=True)
        label = np.array([r[2] for r in rows[:160]])
        near = (unit @ unit.T >= 0.98) & (label[:, None] == label)
        np.fill_diagonal(near, False)
        assert [got[i].n_links for i in range(160)] == near.sum(axis=1).tolist()
        assert got[125].component_id == 60 and got[139].component_id == 130
        assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505))
    assert hnsw.linked_vectors(table.limit(0)).count() == 0


def _near_links(text):
    """Pairs of texts of one paragraph that are similar, by brute force."""
    sets = {}
    for d, words in text.items():
        w = words.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        for a in text for b in text
        if a < b and len(sets[a] & sets[b]) >= substrings.SIMILAR * len(sets[a] | sets[b])
    }


def _classes(spark, text):
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    found = substrings.repeated_paragraphs(docs, Stages(spark, "test")).collect()
    return {r.doc_id: r.class_id for r in found}


def test_similar_paragraphs_are_found(spark):
    text = {}
    for i in range(300):  # the first and the last word differ: similarity 19/23
        words = [f"f{i}w{j}" for j in range(25)]
        text[2 * i] = " ".join(words)
        text[2 * i + 1] = " ".join(["x", *words[1:-1], "y"])
    near = _near_links(text)
    assert len(near) == 300 and max(near.values()) < 0.83
    got = _classes(spark, text)
    found = sum(got.get(a, a) == got.get(b, -b) for a, b in near)
    assert found >= 0.99 * len(near), found


def test_paragraphs_of_a_bucket_are_linked_past_its_hub(spark):
    text = {}
    for i in range(40):  # a template with ten endings, each in three versions
        for k in range(10):
            for last in range(3):
                ends = [f"e{i}k{k}w{j}" for j in range(6)]
                words = [*[f"t{i}w{j}" for j in range(18)], *ends, f"v{last}"]
                text[len(text)] = " ".join(words)
    near = {p: s for p, s in _near_links(text).items() if p[0] // 3 == p[1] // 3}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    keys = {r.doc_id: set(r["keys"]) for r in substrings.paragraphs(docs).collect()}
    got = _classes(spark, text)
    met = [(a, b) for a, b in near if keys[a] & keys[b]]
    lost = [(a, b) for a, b in met if a not in got or got[a] != got.get(b)]
    assert len(near) == 1200 and len(met) > 1100 and not lost, (len(met), len(lost))
    assert len(set(got.values())) == 400  # endings stay apart


def test_blocks_of_a_bucket_find_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 4)
    name = [" ".join([f"k{k // 3}w{j}" for j in range(24)] + [f"v{k}"]) for k in range(60)]
    said = spark.createDataFrame([(k, x.encode()) for k, x in enumerate(name)], "content long, raw binary")
    for main in (1, 30):  # contents already connected to the hub
        rows = [(5, k, min(k, 0) if k < main else k, 0) for k in range(60)]
        members = spark.createDataFrame(rows, "key long, content long, component long, least long")
        links = [tuple(r) for r in substrings._within(members, said).distinct().collect()]
        first = {k: 0 if k < main else k for k in range(60)}
        got = components(
            spark.createDataFrame(links + [(k, v) for k, v in first.items() if k != v or k == 0],
                                  "a long, b long"), Stages(spark, "test")).collect()
        part = {r.node: r.component for r in got}
        assert all(part.get(k, k) == part.get(k - k % 3, k - k % 3) for k in range(main, 60))


def test_a_passage_is_cut_whole(spark):
    text, passage = {}, {}
    for i in range(20):
        words = [f"p{i}w{j}" for j in range((51, 60, 120, 300)[i % 4])]
        passage[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        for copy in range(3):
            own = [f"d{i}c{copy}w{j}é" for j in range(80)]
            text[3 * i + copy] = " ".join([*own[: 20 + 7 * copy], *words, *own[20 + 7 * copy :]])
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text.split() for r in substrings.without_repeats(docs).collect()}
    for d, words in left.items():
        runs = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        if d % 3 == 0:
            assert words == text[d].split()
        else:
            assert not runs & passage[d // 3]
            own = [w for w in text[d].split() if w.startswith("d")]
            assert set(words) <= set(own) and len(words) >= len(own) - 4  # paragraphs similar at an end


def test_signatures_let_similar_pairs_pass():
    p, n = bagminhash.SIMILAR, bagminhash.SIZE
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n) if k / n < bagminhash.PASS)
    assert lost < (1 - p**bagminhash.ROWS) ** bagminhash.BANDS  # less than the bands lose


def test_vectors_of_any_norm_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1e200, 0.0]), (2, 0, [2e200, 1e198]), (3, 0, [3.0, 0.0]), (4, 0, [0.0, 1e300]),
        (5, 0, [1e-200, 1e-202]), (6, 0, [0.0, 2e-320]), (7, 0, [0.0, 0.0]), (8, 0, [nan, 1e200]),
        (9, 0, [inf, 1.0]), (10, 0, [None, 1e200]), (11, 0, None), (12, 0, []), (13, 1, [1e200, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.linked_vectors(df).collect()}
    assert {i: got[i] for i in (1, 2, 3, 5)} == dict.fromkeys((1, 2, 3, 5), (3, 1))
    assert got[4] == got[6] == (1, 4)
    assert all(got[i] == (0, i) for i in (7, 8, 9, 10, 11, 12, 13))
