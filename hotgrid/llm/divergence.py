"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Chunk factorization: documents are counted as white-space chunks, each globally distinct chunk is cut into terms once, and
its terms are joined to its counts. Documents are counted in batches of a bounded size, so what is shuffled is one row per
batch, language and chunk, not per document and chunk; a frequent chunk has one row per batch at most. Sorted by chunk,
equal ones follow each other, are cut once and summed. A term's documents are those of its chunks, each counted once: a
chunk of ``min_docs`` documents settles that its terms stay, a rarer one brings the few documents it has.

A term is a run of letters (A-Z lower-cased, and everything beyond ASCII); a language keeps the terms of at least
``MIN_DOCS`` of its documents. Shares are whole parts of a billion, so all results are exact.

Edge cases: null lang, source or text counts as empty text; a document without terms still makes its group occur; every row
is a document of its own, also with a repeated or null id, numbered as it is read; a very long chunk is one chunk, a very
long text one batch.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotgrid.llm.links import stage
from hotgrid.session import discard

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # on UTF-8 bytes: letters, and all of every wider character
_PLAIN = np.zeros(256, bool)
_PLAIN[97:123] = _PLAIN[128:] = True
MIN_DOCS, TOP_TERMS = 3, 200
PARTS = 1_000_000_000
BATCH_BYTES, BATCH_DOCS = 16 << 20, 20_000
CELLS = 1 << 19  # of a block of terms by sources


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of so many places: the run of each place, and its position in it."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _packed(lang: np.ndarray, ids: np.ndarray, group: np.ndarray, doc: np.ndarray, counts: np.ndarray, part: int, min_docs: int):
    """Per (lang, id): its documents, listed if fewer than ``min_docs``, and occurrences by group, as whole numbers in a row.

    A row is n, then n times (part, document) if n < min_docs, then (group, occurrences) for each group.
    """
    order = np.lexsort((group, ids, lang))
    lang, ids, group, doc, counts = (a[order] for a in (lang, ids, group, doc, counts))
    whole = lang.astype(np.int64) << 40 | ids
    key_at = _starts(whole)
    group_at = _starts(whole * (int(group.max(initial=0)) + 1) + group)
    n_docs = np.diff(np.append(key_at, len(ids)))
    n_groups = np.diff(np.append(np.searchsorted(group_at, key_at), len(group_at)))
    listed = np.where(n_docs < min_docs, n_docs, 0)
    size = 1 + 2 * listed + 2 * n_groups
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int32)
    out[first] = np.minimum(n_docs, min_docs)
    run, at = _spread(listed)
    out[first[run] + 1 + 2 * at] = part
    out[first[run] + 2 + 2 * at] = doc[key_at[run] + at]
    run, at = _spread(n_groups)
    begin = first[run] + 1 + 2 * listed[run] + 2 * at
    out[begin] = group[group_at]
    out[begin + 1] = np.add.reduceat(counts, group_at) if len(group_at) else 0
    return lang[key_at], ids[key_at], out, np.append(first, len(out))


def chunk_counts(docs: DataFrame, groups: dict[tuple[str, str], int], langs: np.ndarray, min_docs: int) -> DataFrame:
    """(lang, chunk, counts): one row per batch, language and chunk; ``langs`` has the language of each group's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        chunks, doc_group, doc_size, ids, counts, size = {}, [], [], [], [], 0

        def made() -> pa.RecordBatch:
            doc = np.repeat(np.arange(len(doc_size)), doc_size)
            group = np.array(doc_group, np.int64)[doc]
            where = np.array(ids, np.int64)
            lang, own, packed, bounds = _packed(langs[group], where, group, doc + (number - len(doc_size)), np.array(counts), part, min_docs)
            names = pa.array(list(chunks), pa.binary()).take(pa.array(own))
            rows = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), names, rows], ["lang", "chunk", "counts"])

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = Counter(text.split())  # bytes are split at ASCII white space only
                doc_group.append(groups[lang, source])
                doc_size.append(len(own))
                ids.extend([chunks.setdefault(c, len(chunks)) for c in own])
                counts.extend(own.values())
                size, number = size + len(text), number + 1
                if size >= BATCH_BYTES or len(doc_group) >= BATCH_DOCS:
                    yield made()
                    chunks, doc_group, doc_size, ids, counts, size = {}, [], [], [], [], 0
        if doc_group:
            yield made()

    return docs.mapInArrow(count, "lang int, chunk binary, counts binary")


def terms_of(chunks: pa.Array) -> pa.Array:
    """The terms of each chunk in order; null where the chunk is its own only term."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
    own = np.diff(plain[offsets - offsets[0]]) == np.diff(offsets)
    cut: list[list[bytes] | None] = [None] * len(chunks)
    for i in np.flatnonzero(~own):
        cut[i] = _TERM.findall(chunks[i].as_py().lower())  # of bytes, so only A-Z change
    return pa.array(cut, pa.list_(pa.binary()))


def cut_chunks(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, group, term, n, doc) from sorted chunk counts: occurrences ``n`` of a term in a group, and with the null group
    the documents of a term, one a row, or the null document if there are ``min_docs`` or more of one chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _cut(batch, min_docs)

    rows = counts.repartition("chunk").sortWithinPartitions("chunk", "lang")
    return rows.mapInArrow(cut, "lang int, group int, term string, n bigint, doc bigint")


def _cut(batch: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    chunk, lang = batch.column("chunk"), batch.column("lang").to_numpy()
    new = np.ones(len(chunk), bool)
    new[1:] = pc.not_equal(chunk.slice(1), chunk.slice(0, len(chunk) - 1)).to_numpy(zero_copy_only=False)
    distinct = chunk.filter(pa.array(new))
    cut = terms_of(distinct)
    kept = cut.is_valid().to_numpy(zero_copy_only=False)
    terms = pa.concat_arrays([distinct, cut.flatten()])
    lengths, first = np.ones(len(distinct), np.int64), np.arange(len(distinct))
    own = pc.list_value_length(cut).fill_null(0).to_numpy()[kept]
    lengths[kept], first[kept] = own, len(distinct) + np.cumsum(own) - own

    # rows of one chunk and language are summed
    run_at = np.flatnonzero(new | np.append(True, lang[1:] != lang[:-1]))
    run = np.searchsorted(run_at, np.arange(len(lang)), "right") - 1
    run_lang, run_chunk = lang[run_at], (np.cumsum(new) - 1)[run_at]
    rows = batch.column("counts")
    bounds = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1] // 4
    values = np.frombuffer(rows.buffers()[2], np.int32)
    n = values[bounds[:-1]].astype(np.int64)
    listed = np.where(n < min_docs, n, 0)
    total = np.bincount(run, weights=n, minlength=len(run_at))
    row, at = _spread(np.where(total[run] < min_docs, listed, 0))
    place = bounds[row] + 1 + 2 * at
    doc, doc_run = values[place].astype(np.int64) << 32 | values[place + 1], run[row]
    sure = np.flatnonzero(total >= min_docs)
    row, at = _spread((np.diff(bounds) - 1) // 2 - listed)
    place = bounds[row] + 1 + 2 * listed[row] + 2 * at
    keys, back = np.unique(run[row].astype(np.int64) << 32 | values[place], return_inverse=True)
    occurrences = np.bincount(back, weights=values[place + 1], minlength=len(keys)).astype(np.int64)

    # occurrences, listed documents and settled terms, each repeated for every term of its chunk
    runs = np.concatenate([keys >> 32, doc_run, sure])
    group = np.concatenate([keys & 0xFFFFFFFF, np.full(len(doc_run) + len(sure), -1)]).astype(np.int32)
    docs = np.concatenate([np.full(len(keys), -1), doc, np.full(len(sure), -1)])
    count = np.concatenate([occurrences, np.zeros(len(doc_run) + len(sure), np.int64)])
    item, at = _spread(lengths[run_chunk[runs]])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(run_lang[runs][item]), pa.array(group[item], mask=group[item] < 0),
            terms.take(pa.array(first[run_chunk[runs]][item] + at)).cast(pa.string()), pa.array(count[item]),
            pa.array(docs[item], mask=docs[item] < 0),
        ],
        ["lang", "group", "term", "n", "doc"],
    )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of the parts ``pair`` and ``term``."""
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text)
    # the result has all pairs of a language's sources, so their list is small beside it
    names = sorted(tuple(r) for r in docs.select("lang", "source").distinct().collect())
    codes = {lang: i for i, lang in enumerate(dict.fromkeys(n[0] for n in names))}
    counts = chunk_counts(docs, {n: i for i, n in enumerate(names)}, np.array([codes[n[0]] for n in names], np.int64), min_docs)
    cut = stage(cut_chunks(counts, min_docs), "cut_chunks", free=True)
    known = cut.where(F.col("group").isNull()).groupBy("lang", "term", "doc").agg(F.count_if(F.col("doc").isNull()).alias("sure"))
    known = known.groupBy("lang", "term").agg(F.sum("sure").alias("sure"), F.count("doc").alias("docs"))
    kept = known.where((F.col("sure") > 0) | (F.col("docs") >= min_docs)).select("lang", "term")
    uses = cut.where(F.col("group").isNotNull()).groupBy("lang", "group", "term").agg(F.sum("n").alias("count")).join(kept, ["lang", "term"])
    # a term has one entry per source at most
    terms = uses.groupBy("lang", "term").agg(F.collect_list(F.struct("group", "count")).alias("own"), F.sum("count").alias("lang_count"))
    terms = stage(terms, "kept_terms", free=True)
    discard(cut)
    total, of_lang = np.zeros(len(names), np.int64), np.zeros((len(codes), 2), np.int64)
    for r in terms.select(F.inline("own")).groupBy("group").agg(F.sum("count").alias("n")).collect():
        total[r["group"]] = r["n"]
    for r in terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_count").alias("n")).collect():
        of_lang[r["lang"]] = r["v"], r["n"]
    langs = [codes[n[0]] for n in names]
    base = np.maximum(total + of_lang[langs, 0], 1)  # what counts are divided by
    whole = np.maximum(of_lang.sum(axis=1)[langs], 1)
    rows = [(i, *n, c, int(x), int(y)) for i, (n, c, x, y) in enumerate(zip(names, langs, base, whole, strict=True))]
    listed = docs.sparkSession.createDataFrame(rows, "group int, lang string, source string, code int, base bigint, lang_base bigint")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(terms, listed, np.array(langs, np.int64), base).withColumn("rank", order).withColumn("part", F.lit("pair"))
    shown = term_values(terms, listed).withColumn("rank", order).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(shown).select("lang", "source", "part", "item", "value", "rank")


def exact_parts(over: Column, under: Column) -> Column:
    """floor(PARTS * over / under) with over <= 2 * under, three digits at a time, as the product can exceed a long."""
    out, rest = F.call_function("div", over, under), over % under
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, under), rest % under
    return out


def _parts(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    out, rest = np.divmod(over, under)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + more
    return out


def pair_values(terms: DataFrame, listed: DataFrame, langs: np.ndarray, base: np.ndarray) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    Every kept term counts for every pair, so a term's row is spread over all sources of its language; these have
    neighbouring numbers. The list of sources goes to every task, and the result has the square of its rows.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_row = batch.column(0).to_numpy()
            for lang in np.unique(of_row):
                own = batch.column(1).filter(pa.array(of_row == lang))
                first, n = int(np.searchsorted(langs, lang)), int((langs == lang).sum())
                rare = 1 + _parts(np.ones(n, np.int64), base[first : first + n])
                sums = np.zeros((n, n), np.int64)
                block = max(1, CELLS // n)
                for at in range(0, len(own), block):
                    part = own.slice(at, block)
                    flat = part.flatten()
                    group, count = flat.field("group").to_numpy(), flat.field("count").to_numpy()
                    shares = np.tile(rare, (len(part), 1))
                    shares[_spread(pc.list_value_length(part).to_numpy())[0], group - first] = 1 + _parts(count + 1, base[group])
                    for a in range(n):
                        off = shares[:, a : a + 1] - shares
                        sums[a] += (off * off // shares).sum(axis=0)
                a, b = np.divmod(np.arange(n * n, dtype=np.int32), np.int32(n))
                columns = [pa.array(a + np.int32(first)), pa.array(b + np.int32(first)), pa.array(sums.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["group", "other", "value"])

    sums = terms.select("lang", "own").mapInArrow(compare, "group int, other int, value bigint")
    sums = sums.groupBy("group", "other").agg(F.sum("value").alias("value"))
    all_of = listed.groupBy("lang").agg(F.collect_list(F.struct(F.col("group").alias("other"), F.col("source").alias("item"))).alias("all"))
    pairs = listed.select("lang", "source", "group").join(all_of, "lang").select("lang", "source", "group", F.inline("all"))
    pairs = pairs.where(F.col("group") != F.col("other")).join(sums, ["group", "other"], "left")
    return pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def term_values(terms: DataFrame, listed: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more of than its language."""
    uses = terms.select(F.col("term").alias("item"), "lang_count", F.inline("own")).join(listed, "group")
    p = 1 + exact_parts(F.col("count") + 1, F.col("base"))
    q = 1 + exact_parts(F.col("lang_count") + 1, F.col("lang_base"))
    more = uses.select("lang", "source", "item", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    off = F.col("p") - F.col("q")
    return more.select("lang", "source", "item", F.call_function("div", off * off, F.col("q")).alias("value"))
