"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and the groups its links form.

After Deng, Tao and Li (2018), brought from overlap to Jaccard similarity. Equal sets are one class from the start. Small
sets enumerate all their subsets of every size that a partner could share; two small sets are linked exactly if they
meet in a subset that is large enough, so nothing has to be verified. Large sets scan inverted lists, of which only the
prefix tokens are needed, in a global order that puts tokens of many documents last. The boundary between small and
large comes from the cost of both ways over the measured histogram of set sizes.

Long lists never turn into all pairs. Each document is first checked against one leader, components are taken, and then
only entries outside the largest component of their list are paired, with entries of other components. What is skipped
lies within one component already, so the groups are exact.

Nulls and edge cases: a null or wordless text has an empty set and forms its own group; a text of fewer words than a
shingle has one shingle; rows of equal id count as one document with all their texts; a null id joins the group of its
set, and gets no group of its own.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.links import MAX_FILTER_BITS, components, fresh, key_filter, passes, stage
from hotgrid.llm.text import U64, list_array, mix, shingle_sets, small_batches
from hotgrid.session import discard

WORDS, PCT = 5, 80
MAX_SMALL = 40  # sizes above are never small: their subsets are too many for any cost
ENTRY_COST = 4.0  # of a list entry with its share of search and verification, against a subset's 1
HEAVY_COUNT, MAX_HEAVY = 16, 1 << 17  # tokens ordered last; which ones are has no effect on results
FLUSH_TOKENS = 1_000_000
PAIRS_PER_ENTRY = 8  # above this many pairs per entry another round of leaders comes first
LIKELY = 0.4  # share of a prefix that a leader must share to be tried; the rest is left to the final search
MAX_STAR_ROUNDS = 6
MAX_BITS = 1 << 14  # of a set's bit pattern; others have one to two bits a token


def ceil_div(a, b):
    return -(-a // b)


def probe_length(n, pct: int):
    """Prefix in which a set of size ``n`` must meet any partner that is not larger."""
    return n - ceil_div(pct * n, 100) + 1


def index_length(n, pct: int):
    """Prefix in which a set of size ``n`` must meet any partner that is not smaller."""
    return n - ceil_div(2 * pct * n, 100 + pct) + 1


def n_subsets(n: int, pct: int) -> int:
    return sum(comb(n, d) for d in range(n - ceil_div(pct * n, 100) + 1))


def choose_boundary(sizes: dict[int, int], pct: int) -> int:
    """The largest size that is small: least sum of subsets below and list entries above, for the sizes counted."""
    best, boundary = float("inf"), 0
    for x in range(MAX_SMALL + 1):
        small = sum(c * n_subsets(n, pct) for n, c in sizes.items() if n <= x)
        large = sum(c * probe_length(n, pct) for n, c in sizes.items() if n > x)
        edge = sum(c * index_length(n, pct) for n, c in sizes.items() if n <= x and 100 * n >= pct * (x + 1))
        if small + ENTRY_COST * (large + edge) < best:
            best, boundary = small + ENTRY_COST * (large + edge), x
    return boundary


def corpus_statistics(docs: DataFrame, k: int) -> DataFrame:
    """(kind, key, n): how many texts have a set of ``key`` shingles (kind 1), and tokens that differing texts share (0).

    Token counts leave out tokens that occur once in a batch; they only order tokens, so they need not be exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4000):
            seen: set[int] = set()
            held: list[np.ndarray] = []
            sizes: dict[int, int] = {}
            size = 0

            def flush(held: list[np.ndarray]) -> pa.RecordBatch:
                tokens, n = np.unique(np.concatenate(held), return_counts=True)
                tokens, n = tokens[n > 1], n[n > 1]
                kinds = pa.array(np.zeros(len(tokens), np.int32))
                return pa.RecordBatch.from_arrays([kinds, pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

            for tokens in shingle_sets(batch.column(0), k):
                if len(tokens) <= 4 * MAX_SMALL:
                    sizes[len(tokens)] = sizes.get(len(tokens), 0) + 1
                sign = int(mix(tokens).sum())
                if sign not in seen:
                    seen.add(sign)
                    held.append(tokens)
                    size += len(tokens)
                if size > FLUSH_TOKENS:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)
            rows = sorted(sizes.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(rows), np.int32)),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                ],
                ["kind", "key", "n"],
            )

    found = docs.select("text").mapInArrow(count, "kind int, key bigint, n bigint")
    return stage(found.groupBy("kind", "key").agg(F.sum("n").alias("n")).where(F.expr(f"kind = 1 or n >= {HEAVY_COUNT}")), "counts")


@lru_cache(maxsize=256)
def _dropped(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), d)), np.int64).reshape(-1, d)


def subset_keys(tokens: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sizes of all subsets of at least ``pct`` per cent of the tokens."""
    n = len(tokens)
    parts, total = mix(tokens), mix(tokens).sum()
    keys, sizes = [], []
    for d in range(n - ceil_div(pct * n, 100) + 1):
        left = total - parts[_dropped(n, d)].sum(axis=1) if d else np.array([total])
        keys.append(mix(left + np.array([n - d], U64) * U64(0x9E3779B97F4A7C15)))
        sizes.append(np.full(len(left), n - d, np.int32))
    return np.concatenate(keys), np.concatenate(sizes)


def bit_pattern(tokens: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them; each token turns over one bit. A pattern of half the bits is its halves' xor.

    A token that two sets share turns over the same bit, so their patterns differ in no more bits than the sets in tokens.
    """
    n = 64
    while n < len(tokens) and n < MAX_BITS:
        n *= 2
    odd = np.bincount((mix(tokens) & U64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signed_sets(docs: DataFrame, k: int, pct: int, heavy: np.ndarray, boundary: int) -> DataFrame:
    """One row per document: set size, signature and bit pattern, subsets of a small set, prefix tokens of a set that needs lists."""
    order = np.argsort(heavy)
    table = docs.sparkSession.sparkContext.broadcast((heavy[order], order))  # at most MAX_HEAVY tokens

    def prefix(tokens: np.ndarray, length: int) -> np.ndarray:
        sorted_heavy, rank = table.value
        if not len(sorted_heavy):
            return tokens[:length]
        at = np.minimum(np.searchsorted(sorted_heavy, tokens), len(sorted_heavy) - 1)
        is_heavy = sorted_heavy[at] == tokens
        light = tokens[~is_heavy][:length]
        if len(light) == length:
            return light
        late = tokens[is_heavy][np.argsort(-rank[at[is_heavy]])]
        return np.concatenate([light, late[: length - len(light)]])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, no_sizes = np.zeros(0, U64), np.zeros(0, np.int32)
        for batch in small_batches(batches):
            n, s1, s2, bits, keys, sizes, tokens = [], [], [], [], [], [], []
            for t in shingle_sets(batch.column(1), k):
                parts = mix(t)
                n.append(len(t))
                s1.append(int(parts.sum()))
                s2.append(int(mix(parts ^ U64(0xA0761D6478BD642F)).sum()))
                bits.append(bit_pattern(t))
                small = 0 < len(t) <= boundary
                sub = subset_keys(t, pct) if small else (none, no_sizes)
                keys.append(sub[0])
                sizes.append(sub[1])
                listed = len(t) > boundary or (len(t) and 100 * len(t) >= pct * (boundary + 1))
                tokens.append(prefix(t, (index_length if small else probe_length)(len(t), pct)) if listed else none)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.array(s1, U64).view(np.int64)),
                    pa.array(np.array(s2, U64).view(np.int64)), list_array(bits, pa.int64()), list_array(keys, pa.int64()),
                    list_array(sizes, pa.int32()), list_array(tokens, pa.int64()),
                ],
                ["doc_id", "n", "s1", "s2", "bits", "subsets", "subset_sizes", "tokens"],
            )

    kind = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bits array<bigint>, subsets array<bigint>, subset_sizes array<int>, tokens array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sign, kind)


def restricted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given documents. While a bounded filter can hold the ids it replaces a shuffle of the rows.

    The filter may let a copy of some set through; a copy has all the links of the set it equals, so no group changes.
    """
    n = ids.count()
    if 10 * n > MAX_FILTER_BITS:
        return rows.join(ids, "doc_id", "left_semi")
    wanted = key_filter(ids, "doc_id", n)

    @F.arrow_udf("boolean")
    def known(ids: pa.Array) -> pa.Array:
        return pa.array(passes(wanted.value, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))

    return rows.where(F.col("doc_id").isNotNull() & known("doc_id"))


def small_links(reps: DataFrame, pct: int) -> DataFrame:
    """Links between small sets: each to the smallest set of a shared subset, if the subset is large enough for both.

    Whatever two members of a subset's group are linked by it are both linked to that smallest set, so groups are whole.
    """
    members = reps.where(F.size("subsets") > 0).select("doc_id", "n", F.explode(F.arrays_zip("subsets", "subset_sizes")).alias("s"))
    members = stage(members.select("doc_id", "n", F.col("s.subsets").alias("key"), F.col("s.subset_sizes").alias("size")), "subsets")
    least = members.groupBy("key").agg(F.min(F.struct("n", "doc_id")).alias("least"), F.count(F.lit(1)).alias("c"))
    least = stage(least.where("c > 1").select("key", F.col("least.n").alias("n0"), F.col("least.doc_id").alias("b")), "least")
    met = members.join(least, "key").where(F.col("doc_id") != F.col("b"))
    return met.where(100 * F.col("size") >= pct * (F.col("n") + F.col("n0") - F.col("size"))).select(F.col("doc_id").alias("a"), "b")


def list_entries(reps: DataFrame, pct: int) -> DataFrame:
    """(key, doc_id, n, pos, prev, lead, m) of every prefix token that two sets or more have; lead is the list's smallest id.

    Lists of two sets whose sizes rule a link out are left out.

    Lists of the same documents, as those of a passage, say the same: the one whose token comes first stays for all ``m`` of
    them. Its token comes first in every set, so its bounds let every pair through that any of the others would.

    ``prev`` is the set's token before that one among those that the filter of kept lists lets pass, null for the first.
    """
    flat = reps.select("doc_id", "n", F.posexplode("tokens").alias("pos", "key"))
    lists = flat.groupBy("key").agg(
        F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("c"), F.sum("pos").alias("p"),
        F.min("n").alias("small"), F.max("n").alias("big"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    )
    lists = lists.where("lead < last").where(f"c > 2 or 100 * small >= {pct} * big").groupBy("c", "x", "y").agg(F.min(F.struct("p", "key", "lead")).alias("l"), F.count(F.lit(1)).alias("m"))
    lists = lists.select("l.key", "l.lead", "m")
    lists = stage(lists, "lists")
    shared = key_filter(lists, "key", lists.count())

    @F.arrow_udf("array<struct<pos:int,key:bigint,prev:bigint>>")
    def known(tokens: pa.Array) -> pa.Array:
        values = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(tokens.offsets.to_numpy())
        first = np.cumsum(lengths) - lengths
        keep = passes(shared.value, values)
        pos = np.arange(len(values)) - np.repeat(first, lengths)
        offsets = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([first, [len(values)]])]
        kept, begins = values[keep], np.zeros(int(keep.sum()) + 1, bool)
        begins[offsets] = True
        prev = pa.array(np.concatenate([[0], kept])[: len(kept)].astype(np.int64), mask=begins[: len(kept)])
        rows = pa.StructArray.from_arrays([pa.array(pos[keep].astype(np.int32)), pa.array(kept), prev], ["pos", "key", "prev"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows)

    entries = reps.where(F.size("tokens") > 0).select("doc_id", "n", F.explode(known("tokens")).alias("t"))
    entries = entries.select(F.col("t.key").alias("key"), "doc_id", "n", F.col("t.pos").alias("pos"), F.col("t.prev").alias("prev"))
    out = stage(entries.join(lists, "key"), "entries", free=True)
    shared.destroy()
    return out


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens): whole sets of the documents in ``ids`` (and, by a filter's false positives, of a few others)."""
    wanted = key_filter(ids, "doc_id", ids.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = batch.filter(pa.array(passes(wanted.value, ids)))
            if part.num_rows:
                sets = list_array(list(shingle_sets(part.column(1), k)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["doc_id", "tokens"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    out = stage(rows.mapInArrow(read, "doc_id bigint, tokens array<bigint>"), "sets")
    wanted.destroy()
    return out


def verified(pairs: DataFrame, docs: DataFrame, k: int, pct: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only the texts of these pairs are read again."""
    pairs = stage(pairs.select("a", "b"), "pairs")
    sets = full_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), k)
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), both.alias("met"))
    return met.where(100 * F.col("met") >= pct * (F.col("n") - F.col("met"))).select("a", "b").distinct()


def favourite(choices: DataFrame, pct: int) -> DataFrame:
    """For each document ``a`` (of set size n) the likely partner ``b`` that most lists propose, if any; ties to the smallest id."""
    votes = choices.where("a <> b").groupBy("a", "n", "b").agg(F.sum("m").alias("v"))
    votes = votes.where(F.col("v") >= LIKELY * (F.col("n") - F.ceil(pct * F.col("n") / 100) + 1))
    return votes.groupBy("a").agg(F.max(F.struct("v", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))


def crossing(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of lists that still hold more than one component; and those of them outside their list's largest one.

    Components only grow, so a list within one of them stays so: the entries given back are all that a later turn needs.
    """
    entries = entries.select("key", "doc_id", "n", "pos", "prev", "lead", "m")
    placed = entries.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = stage(placed.withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    mixed = stage(top.where("parts > 1").select("key", F.col("top.component").alias("main")), "mixed")
    kept = stage(placed.join(mixed, "key"), "placed")
    discard(placed, mixed)
    return kept, kept.where(F.col("component") != F.col("main"))


def pairs_in_reach(placed: DataFrame, pct: int) -> int:
    """About how many pairs the entries outside form with entries of their list that are not too small or large for them.

    Sizes in reach of each other lie in one class or in neighbouring ones. A pair of two entries outside counts once.
    """
    grade = F.floor(F.log("n") / F.log(F.lit(100 / pct))) if pct < 100 else F.col("n")
    outside = F.col("component") != F.col("main")
    per = placed.groupBy("key", grade.alias("g")).agg(F.count_if(~outside).alias("main"), F.count_if(outside).alias("out"))
    near = per.select("key", "main", "out", "g", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"))
    own = F.sum(F.when(F.col("step") == 0, F.col("out")))
    near = near.groupBy("key", F.col("g") + F.col("step")).agg(own.alias("own"), F.sum("main").alias("main"), F.sum("out").alias("out"))
    return near.agg(F.sum(F.col("own") * (F.col("main") + (F.col("out") - 1) / 2))).first()[0] or 0


def cross_pairs(placed: DataFrame, outside: DataFrame, pct: int, boundary: int) -> DataFrame:
    """Pairs of different components that pass the size, prefix and positional bounds of some list.

    A pair is made once, in the first list that both are in. Elsewhere the tokens before may be the same in both sets: then
    an earlier list has the pair too, with bounds that let through no less. Where they differ later on, it comes again.
    """
    x = outside.select("key", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "pos", "prev", "component")])
    y = placed.select("key", *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "n", "pos", "prev", "component")], "main")
    first = F.expr("(y_component = main or x_doc_id > y_doc_id) and (x_prev is null or y_prev is null or x_prev <> y_prev)")
    x_larger = F.expr("x_n > y_n or (x_n = y_n and x_doc_id > y_doc_id)")

    def side(column: str, larger: bool) -> Column:
        x, y = F.col(f"x_{column}"), F.col(f"y_{column}")
        return F.when(x_larger, x if larger else y).otherwise(y if larger else x)

    big, small = side("n", True), side("n", False)
    indexed = small - F.ceil(2 * pct * small / (100 + pct)) + 1
    left = F.least(big - side("pos", True), small - side("pos", False))
    met = x.join(y, "key").where(F.col("x_component") != F.col("y_component")).where(
        first & (big > boundary) & (100 * small >= pct * big) & (side("pos", False) < indexed) & ((100 + pct) * left >= pct * (big + small))
    )
    return met.select(F.greatest("x_doc_id", "y_doc_id").alias("a"), F.least("x_doc_id", "y_doc_id").alias("b")).distinct()


def bounded(pairs: DataFrame, signed: DataFrame, pct: int) -> DataFrame:
    """The pairs whose sizes and bit patterns leave room for a link: two linked sets differ in few tokens, so in few bits."""
    pairs = stage(pairs, "candidates")
    known = restricted(signed, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    left = known.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    right = known.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    xor = lambda u, v: u.bitwiseXOR(v)

    def folded(bits: str, other: str) -> Column:
        """The pattern with as many words as the other one, where it has twice as many; sets that can be linked have no others."""
        half = F.size(other)
        halves = F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), xor)
        return F.when(F.size(bits) > half, halves).otherwise(F.col(bits))

    apart = F.aggregate(F.zip_with(folded("x", "y"), folded("y", "x"), lambda u, v: F.bit_count(xor(u, v))), F.lit(0), lambda t, c: t + c)
    near = (100 * F.least("n_a", "n_b") >= pct * F.greatest("n_a", "n_b")) & ((100 + pct) * apart <= (100 - pct) * (F.col("n_a") + F.col("n_b")))
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b").distinct()


def groups(docs: DataFrame, k: int = WORDS, pct: int = PCT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: the smallest id its links reach."""
    counts = corpus_statistics(docs, k)
    sizes = {r["key"]: r["n"] for r in counts.where("kind = 1 and key > 0").collect()}
    boundary = choose_boundary(sizes, pct)
    heavy = counts.where("kind = 0").orderBy(F.desc("n"), "key").limit(MAX_HEAVY).select("key").toArrow()["key"].to_numpy()
    signed = stage(signed_sets(docs, k, pct, heavy.astype(np.int64).view(U64), boundary), "signed", free=True)

    classes = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes.where(F.col("rep").isNotNull()), "classes")
    reps = restricted(signed, classes.select(F.col("rep").alias("doc_id")))

    links = small_links(reps, pct)
    entries = list_entries(reps, pct)
    pairs = favourite(entries.select(F.col("doc_id").alias("a"), "n", F.col("lead").alias("b"), "m"), pct)
    links = stage(links.union(verified(bounded(pairs, signed, pct), docs, k, pct)), "found")
    n_entries, before = entries.count(), float("inf")
    for turn in range(MAX_STAR_ROUNDS + 1):
        labels = components(links)
        read, (placed, outside) = entries, crossing(entries, labels)
        discard(read)
        entries = placed
        work = pairs_in_reach(placed, pct)
        if not work:
            break
        if work <= PAIRS_PER_ENTRY * n_entries or work > 0.8 * before or turn == MAX_STAR_ROUNDS:
            links = stage(links.union(verified(bounded(cross_pairs(placed, outside, pct, boundary), signed, pct), docs, k, pct)), "found")
            labels = components(links)
            break
        before = work
        # leaders of this turn: one of the main component and one of the rest, for every list
        rank = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id")
        inside = F.col("component") == F.col("main")
        leads = placed.groupBy("key").agg(F.min(F.when(inside, rank)).alias("p"), F.min(F.when(~inside, rank)).alias("q"))
        tried = outside.join(stage(leads, "leads"), "key").select(
            F.col("doc_id").alias("a"), "n", F.col("p.doc_id").alias("p"), F.col("q.doc_id").alias("q"), "m"
        )
        pairs = favourite(tried.select("a", "n", F.col("p").alias("b"), "m"), pct).union(favourite(tried.select("a", "n", F.col("q").alias("b"), "m"), pct))
        links = stage(links.union(verified(bounded(pairs, signed, pct), docs, k, pct)), "found")

    rows = signed.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = WORDS, pct: int = PCT) -> DataFrame:
    """One document of each group, the one of smallest id, with all its columns.

    Repeated rows of that id stay once; rows without an id, which no group can name, all stay.
    """
    member = fresh(docs, "member_id")
    kept = groups(docs, k, pct).where("doc_id = component_id").select(F.col("doc_id").alias(member)).distinct()
    once = docs.join(kept, docs["doc_id"].cast("bigint") == kept[member]).drop(member).dropDuplicates(["doc_id"])
    return once.unionByName(docs.where(F.col("doc_id").isNull()))
