import base64
import hashlib
import io
import itertools
import os
import random
import subprocess
import sys
from pathlib import Path
from urllib.parse import unquote

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm_rows import prose
from nudgetrail.llm import bagminhash, mixing, packing, pu_quality, substrings, warc
from nudgetrail.llm.common import Stages
from nudgetrail.llm.identity import identified
from nudgetrail.llm.sieve import Sieve
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.01"


def test_targets_stop_at_three_times_a_source():
    got = mixing.source_targets({"a": 10, "b": 1000, None: 500})
    assert got["a"] == 30 and abs(sum(got.values()) - 1510) < 1e-6
    assert abs(got["b"] / got[None] - 2) < 1e-9
    assert mixing.source_targets({"a": 0}) == {"a": 0.0}


def test_overlapping_sources_are_filled_at_the_least_cost():
    flows = mixing.route([(("a",), 100), (("a", "b"), 100)], {"a": 150.0, "b": 100.0})
    assert sum(f.get("a", 0) for f in flows) == 150 and flows[1]["b"] == 100
    assert max(sum(flows[0].values()), sum(flows[1].values())) <= 150  # no third time


def test_routes_do_not_depend_on_the_process():
    code = (
        "from nudgetrail.llm import mixing as m\n"
        "sizes = {'a': 900, 'b': 700, 'c': 400, 'd': 300, None: 100}\n"
        "kinds = [(('a', 'b'), 500), (('b', 'c'), 400), (('a', 'c', 'd'), 600), (('d', None), 300),"
        " (('a', 'b', 'c', 'd'), 700), (('b',), 100), ((None, 'a'), 200)]\n"
        "print(m.route(kinds, m.source_targets(sizes)))"
    )
    repo = str(Path(mixing.__file__).parents[2])
    seen = set()
    for seed in range(10):
        env = os.environ | {"PYTHONHASHSEED": str(seed), "PYTHONPATH": repo}
        ran = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True)
        seen.add(ran.stdout)
    assert len(seen) == 1 and seen.pop().startswith("[{")


def _cheapest(kinds, targets, most):
    """The most words that fit, and the least repetition, by trying all flows of whole units."""
    arcs = [(i, s) for i, (members, _) in enumerate(kinds) for s in members]
    best = None
    for flow in itertools.product(*[range(min(most * kinds[i][1], targets[s]) + 1) for i, s in arcs]):
        taken = [sum(f for f, (i, _) in zip(flow, arcs) if i == k) for k in range(len(kinds))]
        filled = {s: sum(f for f, (_, x) in zip(flow, arcs) if x == s) for s in targets}
        if any(t > most * kinds[k][1] for k, t in enumerate(taken)):
            continue
        if any(filled[s] > targets[s] for s in targets):
            continue
        cost = sum(max(0, t - n * kinds[k][1]) for k, t in enumerate(taken) for n in range(1, most))
        best = min(best or (0, 0), (-sum(flow), cost))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_flows_cost_as_little_as_any(seed):
    rng = random.Random(seed)
    kinds = [(m, rng.randrange(1, 4)) for m in (("a",), ("a", "b"), ("b", "c"))]
    targets = {s: rng.randrange(0, 6) for s in "abc"}
    flows = mixing.route(kinds, {s: float(t) for s, t in targets.items()}, 3)
    taken = [sum(f.values()) for f in flows]
    cost = sum(max(0, t - n * size) for t, (_, size) in zip(taken, kinds) for n in range(1, 3))
    assert (-sum(taken), cost) == _cheapest(kinds, targets, 3)


def test_mix_takes_whole_documents_near_the_targets(spark, docs, no_docs):
    big = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed, x = mixing.mix(big, F.array("source"), whole=False)
    rows = mixed.collect()
    taken, target = {}, {}
    for r in rows:
        quota = r[f"{x}quotas"][0]
        assert len(r[f"{x}routed"]) <= 3
        taken[quota.source] = taken.get(quota.source, 0) + r[f"{x}size"] * len(r[f"{x}routed"])
        target[quota.source] = quota.target
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] for s in target)
    again = mixing.mix(big.repartition(5), F.array("source"), whole=False)[0].collect()
    assert sorted((r[0], r[2]) for r in rows) == sorted((r[0], r[2]) for r in again)
    mixed, x = mixing.mix(docs, F.array("source"))
    assert mixed.count() == docs.count() and mixed.columns[:7] == docs.columns
    assert x == "_mix_" and mixing.mix(no_docs, F.array("source"))[0].count() == 0


def test_quality_on_the_held_out_fold(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = pu_quality.train(docs, labels)
    scored = pu_quality.score(docs, model).join(labels, "doc_id")
    held = scored.where(pu_quality.fold(F.col("doc_id")) == 0).toPandas()
    assert ((held.score >= pu_quality.KEEP) == (held.quality == 1)).mean() > 0.95
    assert (held.score[held.quality == 1] >= pu_quality.KEEP).mean() > 0.98
    assert held.score.between(0, 1).all()
    nothing = pu_quality.train(docs, labels.limit(0))
    assert nothing is None and pu_quality.score(no_docs, nothing).count() == 0
    assert pu_quality.accepted(no_docs, model).columns == no_docs.columns


def test_features_of_empty_texts_are_finite():
    assert np.isfinite(pu_quality.features([b"", b" \n", b"x"])).all()


def test_archives_give_back_every_page(spark, tmp_path):
    rows = [(3, "http://a b/\n", "x\r\n\r\nWARC/1.1\r\né"), (1, None, None), (2, "u", ""),
            (9, "u", "x\r\n\r\nWARC/1.1\r\né"), (9, "u", "x\r\n\r\nWARC/1.1\r\né"),
            (None, "u", "y"), (4, "u", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(got) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        digest = base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), digest)
        if r.record_type == "response":
            assert r.payload == html[r.page_id]
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[2] == ("revisit", 1) and kinds[9] == ("revisit", 3)
    assert all(kinds[p] == ("response", None) for p in (1, 3, 4, None))
    warc.write_archives(pages, str(tmp_path / "s"), smallest=1)
    short = {r.page_id: r.record_type for r in warc.read_archives(spark, str(tmp_path / "s")).collect()}
    assert short[2] == "response" and short[9] == "revisit"


def test_urls_come_back_from_their_headers(spark, tmp_path):
    urls = {1: "http://a\tb\nc d", 2: "http://a/100%", 3: "http://a/b%20c%zz", 4: "http://a/\u00e9?q=1"}
    pages = spark.createDataFrame([(k, u, "x") for k, u in urls.items()], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "u"))
    got = {r.page_id: r.url for r in warc.read_archives(spark, str(tmp_path / "u")).collect()}
    assert got == {
        1: "http://a%09b%0Ac%20d", 2: "http://a/100%25", 3: "http://a/b%20c%25zz", 4: urls[4],
    }
    assert unquote(got[1]) == urls[1] and unquote(got[2]) == urls[2]


def test_a_damaged_archive_is_refused():
    record = b"WARC/1.1\r\nWARC-Record-ID: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc._records_in(io.BytesIO(record * 2))] == [b"abc"] * 2
    for broken in (record[:-5], record[1:], record.replace(b"abc", b"ab"), record[:20]):
        with pytest.raises(ValueError):
            list(warc._records_in(io.BytesIO(record + broken)))


def test_a_sieve_lets_every_wanted_row_through(spark):
    rows = spark.range(0, 200_000).withColumnRenamed("id", "doc_id")
    wanted = rows.where("doc_id % 100 = 7").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    kept = Sieve(wanted, "doc_id").kept(rows, "doc_id")
    assert kept.join(wanted, "doc_id", "left_semi").count() == 2000
    assert kept.count() < 0.1 * 200_000
    assert Sieve(wanted.limit(0), "doc_id").kept(rows, "doc_id").count() == 0


def test_documents_without_an_id_are_deduplicated_too(spark):
    text, other = prose(21, 120), prose(22, 120)
    near = text.replace(text.split()[60], "changed")
    passage = prose(23, 70)
    rows = [(3, text, "a", 1), (None, text, "b", 2), (None, near, "c", 3), (None, other, "d", 5),
            (None, other, "c", 4), (9, other + " end", "x", 1), (9, other + " end", "w", 1),
            (None, None, "n", 1), (None, "", "m", 1), (12, passage, "p", 1),
            (None, f"{prose(24, 90)} {passage} {prose(25, 90)}", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone int").repartition(4)
    one, key = identified(docs, Stages(spark, "test"))
    assert one.where(f"{key} IS NULL").isEmpty() and one.count() == 8
    kept = bagminhash.without_copies(docs).collect()
    assert {(r.doc_id, r.source, r.gone) for r in kept} == {
        (3, "a", 1), (9, "w", 1), (None, "m", 1), (12, "p", 1), (None, "q", 1),
    }
    found = bagminhash.near_duplicates(docs).collect()
    classes = sorted((r.doc_id or -1, r.class_id if r.class_id < 100 else -1, r.kept) for r in found)
    assert classes == [(-1, -1, True), (-1, -1, True), (-1, 3, False), (-1, 3, False), (-1, 9, False),
                       (3, 3, True), (9, 9, True), (12, 12, True)]
    left = {(r.doc_id, r.source): r.text for r in substrings.without_repeats(docs).collect()}
    assert left[None, "q"].split() == (prose(24, 90) + " " + prose(25, 90)).split()
    assert left[12, "p"] == passage and (None, "b") not in left


def test_run_applies_the_stages_one_after_another(spark, tmp_path):
    rows = [(i, prose(40 + i, 60 + i % 40), "en", "a", 0) for i in range(60)]  # one source: all are taken
    rows += [(100 + i, prose(40 + i, 60 + i % 40), "en", "a", 0) for i in range(20)]  # copies
    rows += [(200, f"{prose(190, 50)} {rows[0][1]} {prose(191, 50)}", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([], "doc_id long, quality int")  # no labels: nothing is rejected
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = {r[0]: r for r in rows if not 100 <= r[0] < 200}
    left[200] = (200, f"{prose(190, 50)} {prose(191, 50)}", "en", "b", 0)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    size = {d: len(library.encode(" ".join(r[1].split()), add_special_tokens=False).ids) for d, r in left.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(left)
    for p in pieces:
        assert abs(p.doc_tokens - 1 - size[p.doc_id]) <= 1  # the cut leaves a blank more
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    ends = {}
    for sequence, offset, length in places:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert all(n == packing.WINDOW for s, n in ends.items() if s < max(ends))


def test_stages_keep_columns_and_survive_odd_rows(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1), (4, 1), (10, 0)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, no_docs):
        for name, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, rows, str(tmp_path))
            assert out.columns == rows.columns, name
            out.write.parquet(str(tmp_path / f"{name}-{rows is docs}"))
