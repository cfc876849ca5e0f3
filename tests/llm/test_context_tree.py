"""Context-tree scores against a plain recursion over all contexts, and the word base against a plain count."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import FOLDER, edge_texts
from pyspark.sql import functions as F

from hotgrid import llm
from hotgrid.llm import context_tree

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class PlainTrees:
    """One dictionary of bit counts per context and bit node; probabilities by the recursion as it is written down."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children, self.memo = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for text in texts:
            for context, symbol in self.steps(text):
                for node, bit in self.bits(symbol):
                    for d in range(depth + 1):
                        self.counts[node, context[depth - d :]][bit] += 1
                        if d:
                            self.children[node, context[depth - d + 1 :]].add(context[depth - d :])

    def steps(self, text):
        data = b"\xff" * self.depth + text.translate(FOLD).encode() + b"\xff"
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    def bits(self, symbol):
        node = 1
        for i in range(7, -1, -1):
            yield node, symbol >> i & 1
            node = node << 1 | symbol >> i & 1

    def estimate(self, node, context):
        zeros, ones = self.counts.get((node, context), (0, 0))
        out = 0.0
        for i in range(zeros):
            out += math.log((i + 0.5) / (i + 1))
        for i in range(ones):
            out += math.log((i + 0.5) / (zeros + i + 1))
        return out

    def weighted(self, node, context):
        if (node, context) not in self.memo:
            value = self.estimate(node, context)
            if len(context) < self.depth:
                deeper = sum(self.weighted(node, c) for c in self.children[node, context])
                value = math.log(0.5) + np.logaddexp(value, deeper)
            self.memo[node, context] = value
        return self.memo[node, context]

    def bit(self, node, bit, whole, d):
        context = whole[self.depth - d :]
        counts = self.counts.get((node, context), (0, 0))
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        if d == self.depth:
            return own
        stop = 0.5 * math.exp(self.estimate(node, context) - self.weighted(node, context))
        return stop * own + (1 - stop) * self.bit(node, bit, whole, d + 1)

    def score(self, text):
        return sum(math.log10(self.bit(n, b, c, 0)) for c, s in self.steps(text) for n, b in self.bits(s))


def word_base(rows):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(FOLD)) if w] + [None]
    learnt = Counter(w for i, t in rows if not is_held(i) for w in split(t))
    total, distinct = sum(learnt.values()), len(learnt)
    out = []
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((learnt[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((i, is_held(i), len(words), sum(learnt[w] > 0 for w in words), total, base))
    return out


def check(rows, got, depth):
    want = {}
    for r in word_base(rows):
        want.setdefault(r[0], []).append(r)
    trees = PlainTrees([t or "" for i, t in rows if not is_held(i)], depth)
    assert len(got) == len(rows)
    for i in want:
        mine = [r for r in got if r["doc_id"] == i]
        assert [tuple(r)[:5] for r in mine] == [w[:5] for w in want[i]] or len(mine) > 1
        assert sorted(r["base_score"] for r in mine) == pytest.approx(sorted(w[5] for w in want[i]), rel=1e-9)
        assert sorted(r["score"] for r in mine) == pytest.approx(sorted(trees.score(t or "") for j, t in rows if j == i), rel=1e-9)


@pytest.mark.parametrize("depth", [2, 4])
def test_edges_equal_plain(spark, edge, monkeypatch, depth):
    rows = [(i, t) for i, t in edge_texts() if t is None or len(t) < 1500]
    monkeypatch.setattr(context_tree, "BATCH_DOCS", 5)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 100)
    df = edge.where("text is null or length(text) < 1500")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = context_tree.scores(df, held, depth).collect()
    check(rows, got, depth)


def test_query_equals_plain(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is null or length(text) < 600").orderBy("doc_id").limit(25)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, llm.queries()["op13_context_trees"](spark, str(tmp_path)).collect(), context_tree.DEPTH)


def test_held_out_code_length(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = llm.queries()["op13_context_trees"](spark, FOLDER).collect()
    assert [tuple(r)[:5] for r in sorted(got)] == [w[:5] for w in sorted(word_base([(r["doc_id"], r["text"]) for r in rows]))]
    size = sum(len((r["text"] or "").encode()) + 1 for r in rows if is_held(r["doc_id"]))
    assert -sum(r["score"] for r in got if r["held_out"]) * math.log2(10) / size < 4.0  # bits a byte; eight without a model


def test_no_training_texts(spark, edge, nothing):
    assert not context_tree.scores(nothing, F.lit(False)).collect()
    got = context_tree.scores(edge.where("doc_id in (5, 7)"), F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(5, 0, 0, 0.0), (7, 0, 0, 0.0)]
    assert sorted(r["score"] for r in got) == pytest.approx([-32 * math.log10(2), -8 * math.log10(2)])


def test_probabilities_of_all_bytes_sum_to_one():
    grams, n = context_tree.distinct_grams([b"abracadabra", b"abrakadabra", b"", "é".encode()], 3)
    context = int.from_bytes(b"abr", "big")
    all_bytes = np.unique(np.concatenate([grams, (context << 8) + np.arange(256)]))
    counts = np.zeros(len(all_bytes))
    counts[np.searchsorted(all_bytes, grams)] = n
    top = context_tree.Top(pa.Table.from_batches([context_tree.upper_rows(all_bytes, counts, 3)]))
    scores = context_tree.gram_scores(all_bytes, counts, 3, top)
    assert (10 ** scores[all_bytes >> 8 == context]).sum() == pytest.approx(1.0, abs=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 100.5, 1e6])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
