"""Divergence of the sources of a language: how far their word use lies apart, and the words that stand out.

Every language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. A source's share of a
term is a whole number (add-two smoothed, per thousand million), and two shares p and q are
``(p - q)^2 div (p + q)`` apart.

The value of two sources is summed over all kept terms, most of which neither has. It is put together
like a row of a sparse product:

* baseline: each kept term at the sources' zero shares, one number for all terms;
* one-sided correction: the terms that a source has, against the other's zero share. Terms with equal
  shares count together, so this is a small table (source, share, terms) met by the peers' zero shares;
* two-sided correction: the terms that both have. The postings are dealt by term; within a task each
  source scatters its terms through the term-major index (its terms' posting lists) into one dense
  accumulator over its peers, and only the filled accumulators leave the task, so no pair of postings is
  ever emitted.

Counting: a task counts the words of a slice of texts by dictionary, then one shuffle by (language, term)
brings counts, document frequencies and the language's totals. A frequent term has one row per slice and
source there, a posting list one entry per source. Nothing is collected to the driver.

Defined results: null text, lang and source count as ''. Rows are documents, repeated rows count again.
A group without kept terms has the zero share everywhere; where a language keeps no term, its pairs have
value 0 and there are no term rows. doc_id and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcheck.llm.common import byte_table, parts, ragged, slices, stored, word_strings, words

#: Terms are ASCII letters and all characters beyond ASCII.
LETTERS = byte_table(letters=bytes([*range(97, 123), *range(128, 256)]))
LEAST_DOCS = 10
#: A share is so many parts of all.
SCALE = 1_000_000_000
#: Terms reported for a group.
TOP = 10
#: Bytes of text counted together, and postings looked at together.
COUNT_BYTES, SCATTER = 16 << 20, 1 << 22


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) by slice of texts; every group has a row with a null term too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=COUNT_BYTES):
            w = words(b.column("text"), LETTERS, lower=True)
            coded = word_strings(w, LETTERS).dictionary_encode()
            n_terms = max(len(coded.dictionary), 1)
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            keys = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
            groups, row, group = np.unique(keys, return_index=True, return_inverse=True)
            # Occurrences in each document first, then documents and occurrences in each group.
            at = w.doc() * n_terms + coded.indices.to_numpy()
            at.sort()
            head = np.flatnonzero(np.diff(at, prepend=-1))
            count = np.diff(head, append=len(at))
            key = group[at[head] // n_terms] * n_terms + at[head] % n_terms
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            head = np.flatnonzero(np.diff(key, prepend=-1))
            own = np.concatenate([np.arange(len(groups)), key[head] // n_terms])
            none = np.arange(len(own)) < len(groups)
            term = np.concatenate([np.zeros(len(groups), np.int64), key[head] % n_terms])
            zero = np.zeros(len(groups), np.int64)
            rows = pa.array(row[own])
            yield pa.RecordBatch.from_arrays([
                b.column("lang").take(rows), b.column("source").take(rows), coded.dictionary.cast(pa.string()).take(pa.array(term, mask=none)),
                pa.array(np.concatenate([zero, np.add.reduceat(count, head) if len(head) else zero[:0]])),
                pa.array(np.concatenate([zero, np.diff(head, append=len(key))]))], ["lang", "source", "term", "n", "docs"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), in decimals so that no count is too large."""
    return F.expr(f"1L + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0)) div CAST(nullif({total} + 2 * {kept}, 0) AS DECIMAL(20, 0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def kept_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored postings (lang, source, term, p, z, q) and groups (lang, source, kept, z).

    p, z and q are the shares of the term in the group, of a term that the group lacks, and in the language.
    """
    same = Window.partitionBy("lang", "term")
    dealt = term_counts(docs).repartition(parts(docs), "lang", "term")
    counts = (dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
              .select("lang", "term", "source", "n", F.sum("docs").over(same).alias("df"), F.sum("n").over(same).alias("n_lang"),
                      (F.min("source").over(same) == F.col("source")).alias("first"))
              .where((F.col("df") >= LEAST_DOCS) | F.col("term").isNull()).drop("df"))
    counts = stored(counts, "counts")
    kept = counts.where("term IS NOT NULL")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("n").alias("total_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "kept", "total_lang"]).withColumn("z", share("0", "total", "kept")))
    groups = stored(groups, "groups")
    postings = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "kept").alias("p"), "z", share("n_lang", "total_lang", "kept").alias("q"))
    return postings, groups


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def accumulate(group: np.ndarray, term: np.ndarray, p: np.ndarray, z: np.ndarray, n_groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every group its accumulated two-sided corrections against all later groups.

    Entries are sorted by term; ``z`` is the zero share of each entry's group.
    """
    first = np.searchsorted(term, term, "left")
    last = np.searchsorted(term, term, "right")
    rows = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[rows], np.arange(n_groups + 1))
    for g in range(n_groups):
        own = rows[bounds[g]:bounds[g + 1]]
        acc = np.zeros(n_groups, np.int64)
        length = last[own] - first[own]
        cuts = np.searchsorted(np.cumsum(length), np.arange(SCATTER, int(length.sum()) + SCATTER, SCATTER)) if len(own) else []
        done = 0
        for to in [*(int(c) + 1 for c in cuts)]:
            mine, size = own[done:to], length[done:to]
            done = max(done, to)
            peer, me = ragged(first[mine], size), np.repeat(mine, size)
            later = group[peer] > g
            peer, me = peer[later], me[later]
            np.add.at(acc, group[peer], _gap(p[me], p[peer]) - _gap(p[me], z[peer]) - _gap(z[me], p[peer]) + _gap(z[me], z[peer]))
        yield g, acc


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    coded = [t[c].chunk(0).dictionary_encode() if t.num_rows else None for c in ("lang", "source", "term")]
    if coded[0] is None:
        return
    lang, source, term = (c.indices.to_numpy().astype(np.int64) for c in coded)
    key = lang * len(coded[1].dictionary) + source
    groups, group = np.unique(key, return_inverse=True)
    term = lang * len(coded[2].dictionary) + term
    order = np.argsort(term, kind="stable")
    p, z = (t[c].to_numpy()[order] for c in "pz")
    of_lang, of_source = np.divmod(groups, len(coded[1].dictionary))
    for g, acc in accumulate(group[order], term[order], p, z, len(groups)):
        peers = np.flatnonzero(acc)
        me = np.full(len(peers), g)
        a, b = np.concatenate([me, peers]), np.concatenate([peers, me])
        yield pa.RecordBatch.from_arrays([
            coded[0].dictionary.take(pa.array(of_lang[a])), coded[1].dictionary.take(pa.array(of_source[a])),
            coded[1].dictionary.take(pa.array(of_source[b])), pa.array(np.concatenate([acc[peers]] * 2))], ["lang", "source", "item", "value"])


def pair_values(postings: DataFrame, groups: DataFrame, n_parts: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways round."""
    peers = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    other = F.col("source") != F.col("item")
    base = groups.join(peers, "lang").where(other).select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * apart("z", "y")).otherwise(0).alias("value"))
    alike = postings.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("m"))
    one = alike.join(peers, "lang").where(other).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (apart("p", "y") - apart("z", "y"))).alias("value"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    two = postings.select("lang", "source", "term", "p", "z").repartition(n_parts, "lang", "term").mapInArrow(_scatter, "lang string, source string, item string, value long")
    return base.union(one).union(back).union(two).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked(df: DataFrame, top: int | None = None) -> DataFrame:
    """``df`` with ranks in each group; for the first ``top`` alone, parts of a group are ranked first."""
    order = [F.desc("value"), F.asc("item")]
    if top:
        part = F.pmod(F.xxhash64("item"), F.lit(64))
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "source", part).orderBy(*order))).where(F.col("_k") <= top).drop("_k")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return df.where(F.col("rank") <= top) if top else df


def source_divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by value, and the ``top`` terms used more than in the language."""
    postings, groups = kept_terms(docs)
    pairs = ranked(pair_values(postings, groups, parts(docs)))
    terms = ranked(postings.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value")), top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
