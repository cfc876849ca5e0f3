"""Source divergence against a plain count in whole numbers, on cases the tables do not have."""

import re
from collections import Counter, defaultdict

import pytest

from hotgrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=3, top=200):
    docs, own, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(FOLD))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        own[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for g, s in groups if g == lang]
        share = {}
        for s in sources:
            n = sum(own[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (own[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        total = sum(own[lang, s][t] for s in sources for t in kept)
        whole = {t: 1 + 10**9 * (sum(own[lang, s][t] for s in sources) + 1) // (total + len(kept)) for t in kept}
        p = share[source]
        pairs = [(sum((p[t] - share[s][t]) ** 2 // share[s][t] for t in kept), s) for s in sources if s != source]
        terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if own[lang, source][t] and p[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda f: (-f[0], f[1].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


ROWS = [
    ("The the, THE (cat) été", "en", "a"), ("the cat's cat", "en", "b"), ("the dog-cat", "en", "a"), ("dog the", "en", None),
    (None, "en", "c"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("solo", None, None), ("x" * 300_000, "en", "a"),
    ("é É é b", None, "s"), ("é b", None, "s"), ("é b\tb\x0bb", "", "r"), ("é_b", "", "r"),
] + [("the cat sat", "en", "a")] * 5


@pytest.mark.parametrize("batch_docs", [20_000, 2])
def test_equals_plain(spark, monkeypatch, batch_docs):
    monkeypatch.setattr(divergence, "BATCH_DOCS", batch_docs)
    df = spark.createDataFrame([(*r, 7, "k") for r in ROWS], "text string, lang string, source string, batch int, term string")
    for min_docs, top in ((3, 200), (1, 2), (100, 5)):
        got = divergence.audit(df, min_docs, top).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(tuple(r) for r in got.collect()) == plain(ROWS, min_docs, top)


def test_empty(spark):
    out = divergence.audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert not out.collect()


def test_parts_are_exact(spark):
    cases = [(1, 3), (2**53, 2**53 + 1), (9 * 10**15, 9 * 10**15), (7, 7), (8, 7), (123456789, 987654321987)]
    df = spark.createDataFrame(cases, "a bigint, b bigint")
    got = df.select("a", "b", divergence.exact_parts(df["a"], df["b"]).alias("v")).collect()
    assert [r["v"] for r in got] == [10**9 * r["a"] // r["b"] for r in got]
