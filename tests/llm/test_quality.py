import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import common as C
from tidewater.llm import quality as Q

SF = "/root/testdata/sf0.01"


def chain_score(path, score, model):
    total = model.start * path[0] + sum(s * y for s, y in zip(score, path))
    return total + sum(model.trans[a][b] for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_equals_enumeration(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 8)
    model = Q.Model((), tuple(tuple(rnd.gauss(0, 1) for _ in range(2)) for _ in range(2)), rnd.gauss(0, 1))
    score = [rnd.gauss(0, 1) for _ in range(n)]
    best = max(itertools.product((0, 1), repeat=n), key=lambda p: chain_score(p, score, model))
    assert tuple(Q.viterbi(score, model)) == best
    assert Q.viterbi([], model) == []


def test_likelihood_and_gradient_equal_enumeration():
    rng = np.random.default_rng(1)
    score, trans, start = rng.normal(size=(2, 3)), rng.normal(size=(2, 2)), 0.3
    label, mask = np.array([[1.0, 0, 1], [0, 1, 0]]), np.array([[1, 1, 1], [1, 1, 0]], bool)
    model = Q.Model((), tuple(map(tuple, trans)), start)

    def brute():
        total = 0.0
        for i, n in enumerate((3, 2)):
            z = [chain_score(p, score[i, :n], model) for p in itertools.product((0, 1), repeat=n)]
            total += chain_score(label[i, :n].astype(int), score[i, :n], model) - np.log(np.exp(z).sum())
        return total

    value, g, _, _ = Q.log_likelihood(score, label, mask, trans, start)
    assert value == pytest.approx(brute())
    for i, j in ((0, 0), (0, 2), (1, 1)):
        old = brute()
        score[i, j] += 1e-6
        assert (brute() - old) / 1e-6 == pytest.approx(g[i, j], abs=1e-4)
        score[i, j] -= 1e-6
    assert g[1, 2] == 0


def test_features_per_line():
    data, offs = C.utf8(pa.array(["Ab c.\n\n  \nXX!!", None, "", "é\n"]))
    x, size, alive, per = Q.features(data, offs)
    assert per.tolist() == [4, 1, 1, 2] and alive.tolist() == [0, 3, 6] and size.tolist() == [5, 4, 2]
    assert x[0, Q.FEATURES.index("ends_sentence")] == 1 and x[1, Q.FEATURES.index("upper")] == 1


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs.where("doc_id % 2 = 0"), labels)
    held = docs.where("doc_id % 2 = 1").join(labels, "doc_id")
    kept = {r.doc_id for r in Q.quality_rules(held, model).collect()}
    rows = held.select("doc_id", "quality").collect()
    good = [r.doc_id in kept for r in rows if r.quality == 1]
    bad = [r.doc_id in kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_edge_cases(spark):
    long = "The cat sat on the mat.\n" * 20_000
    junk = "X#X### " * 30
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, long, "a"), (5, "A line.", "b"), (5, "A line.", "b"), (None, "A line.", "b"), (6, junk, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality_lines string")
    model = Q.fit([long[:2400], "A line.", "Some more of it.", junk, "### X### " * 20] * 5, [1, 1, 1, 0, 0] * 5)
    out = Q.quality_rules(docs, model)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.quality_lines) for r in out.collect()) == [(0, "b"), (4, "a"), (5, "b"), (5, "b")]
    scored = {r.doc_id: r for r in Q.quality_rules(docs, model, keep_scores=True).collect()}
    assert scored[4].line_labels == "C" * 20_000 and scored[4].content_share == 1
    assert Q.quality_rules(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert Q.train(docs, none) == Q.NEUTRAL
    assert Q.quality_rules(docs, Q.NEUTRAL).count() == 5


def plain_lines(text):
    """(features, bytes) of the lines that aren't blank, byte by byte."""
    word = lambda b: b >= 128 or chr(b).isalnum()
    out = []
    for line in text.encode().split(b"\n"):
        if not line.strip(b" \t\r"):
            continue
        n = lambda chars: sum(b in chars for b in line)
        chars = max(sum(b & 0xC0 != 0x80 for b in line), 1)
        letters = sum(chr(b).isalpha() if b < 128 else b >= 0xC0 for b in line)
        words, now = [], b""
        for b in [*line, 32]:
            if word(b):
                now += bytes([b])
            elif now:
                words.append(now)
                now = b""
        look = [(len(w), w[0], w[-1], line_at) for w, line_at in zip(words, (w[len(w) // 2] for w in words))]
        m = max(len(words), 1)
        lag = lambda k: sum(look[i] == look[i - k] for i in range(k, len(look))) / m
        x = [1, letters / chars, sum(65 <= b <= 90 for b in line) / max(letters, 1), n(b"0123456789") / chars, n(b" \t\r") / chars, 4 * n(b"#$%&*|<>{}[]=~^\\_/@+") / chars, 4 * n(b"!?") / chars, 4 * n(b".,;:'\"") / chars, math.log1p(chars) / 6, min(sum(map(len, words)) / m, 30) / 10, sum(len(w) <= 3 for w in words) / m, lag(1), lag(2), line[-1] in b".!?:;\"'", 65 <= line[0] <= 90]
        out.append((x, len(line)))
    return out


def test_whole_decision_by_a_plain_version(spark):
    """From the bytes to the share, without the operator's own features: all labellings of a document are tried."""
    rng, rnd = np.random.default_rng(3), random.Random(3)
    piece = ["Hello world.", "été noël", "ABC 12 34 !!!", "na na na na na", "#$% *** ===", "\t x", " ", "", "a ab a ab a", "x\r", "日本語 テキスト", "Ünder, 'quoted'"]
    texts = ["\n".join(" ".join(rnd.choices(piece, k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 7))) for _ in range(60)] + ["", " \n ", None]
    model = Q.Model(tuple(rng.normal(size=len(Q.FEATURES))), ((0.7, -0.4), (-0.3, 0.6)), 0.2)
    got = Q.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, 0.1, keep_scores=True).collect()
    want = {}
    for i, t in enumerate(texts):
        lines = plain_lines(t or "")
        if not lines:
            continue
        score = [sum(w * v for w, v in zip(model.weights, x)) for x, _ in lines]
        value = lambda y: sum(s * k for s, k in zip(score, y)) + model.start * y[0] + sum(model.trans[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        share = sum(n for (_, n), k in zip(lines, best) if not k) / sum(n for _, n in lines)
        if share >= 0.1:
            want[i] = ("".join("CB"[k] for k in best), share)
    assert {r.doc_id: r.line_labels for r in got} == {i: x for i, (x, _) in want.items()} and 5 < len(want) < 61
    assert all(abs(r.content_share - want[r.doc_id][1]) < 1e-12 for r in got)


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"Text number {i}.") for i in range(50)] + [(2, "### !!!")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id bigint, quality int")
    assert Q.train(docs, labels) == Q.fit(["Text number 0.", "### !!!"], [1, 0])
