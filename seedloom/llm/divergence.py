"""How far the sources of a language lie apart in their words, exactly and without a dense table.

Postings are the counts above 0 of kept terms in (lang, source) groups. What a pair of sources differs by is the sum over all kept terms; terms
that neither has, or one alone, are told from counts of counts, so that only terms that both have meet in a join.

The terms by which a source stands out most from its language are searched best first: terms of a group with one count have one
probability, and the least probability that the language has among them bounds them all. Buckets are opened in order of their bounds, for all groups at once, until what
is left unopened lies strictly below a group's last wanted value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A term is a run of ASCII letters and anything beyond ASCII; all else becomes a space, A to Z lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Terms of all groups that a task holds before it sends their counts on.
MOST_TERMS = 400_000
#: Buckets of a group opened in the first round; each further round opens four times as many.
FIRST, GROWTH = 64, 4
ONE = 1_000_000_000
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) -> lang, source, term, n (occurrences), docs (documents that have it); and a row without a term for each group.

    A task sums what it reads before anything is shuffled, so a word that all documents have is a row or a few of each task.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = list(n)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = [[lang] * (len(n) + 1), [source] * (len(n) + 1), pa.array([None, *terms], pa.binary()).cast(pa.string(), safe=False), [0, *n.values()], [0, *(docs[t] for t in terms)]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist()):
                if (own := groups.get((lang, source))) is None:
                    own = groups[lang, source] = (Counter(), Counter())
                    held += 1
                words, before = (text or b"").translate(FOLD).split(), len(own[0])
                own[0].update(words)
                own[1].update(set(words))
                held += len(own[0]) - before
                if held > MOST_TERMS:
                    yield from told()
                    held = 0
        yield from told()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (n + 2) / (total + 2 kept)): whole-number division of decimals, since counts may be of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * whole(n + 2), whole(total + 2 * kept)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)) of probabilities as above: at most 10**18 is divided."""
    off = (p - q).cast("long")
    return F.call_function("div", off * off, p + q)


def postings(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n: counts above 0 of the terms that at least ``least_docs`` documents of their language have, and the language's."""
    all_ = Window.partitionBy("lang", "term")  # a row for each source
    rows = counts.where(F.col("term").isNotNull()).withColumn("_docs", F.sum("docs").over(all_)).withColumn("lang_n", F.sum("n").over(all_))
    return rows.where(F.col("_docs") >= least_docs).select(*GROUP, "term", "n", "lang_n")


def totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, terms (kept ones that it has), kept, lang_total of every group, those without terms too."""
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    rows = counts.where(F.col("term").isNull()).select(*GROUP).join(own, GROUP, "left").join(langs, "lang", "left")
    return rows.select(*GROUP, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "kept", "lang_total")])


def pair_values(kept: DataFrame, groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """lang, source, item, value: for each two sources of a language, both ways, their terms' gaps summed over all kept terms.

    A sum has three parts: each source's terms as if the other had none of them; terms that neither has, which are all alike; and, for terms that both
    have, what that first part took them for wrongly. buckets: lang, source, n, terms, p.
    """
    none = groups.withColumn("p0", F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"), F.col("kept"))))
    other = none.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.col("terms").alias("other_terms"))
    two = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    alone = buckets.join(other, "lang").where(F.col("source") != F.col("other"))
    alone = alone.select("lang", *two("source", "other"), (F.col("terms") * gap(F.col("p"), F.col("other_p0"))).alias("value"))
    neither = none.join(other, "lang").where(F.col("source") < F.col("other"))
    without = F.when(F.col("kept") > 0, (F.col("kept") - F.col("terms") - F.col("other_terms")) * gap(F.col("p0"), F.col("other_p0"))).otherwise(0)
    neither = neither.select("lang", *two("source", "other"), without.alias("value"))
    own = kept.join(none.select(*GROUP, "total", "kept", "p0"), GROUP).select(*GROUP, "term", "p0", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    theirs = own.select("lang", "term", F.col("source").alias("b"), F.col("p0").alias("q0"), F.col("p").alias("q"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = own.join(theirs, ["lang", "term"]).where(F.col("source") < F.col("b"))
    both = both.select("lang", F.col("source").alias("a"), "b", (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("value"))
    summed = alone.unionByName(neither).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.select("lang", F.inline(ways), "value")


def top_terms(kept: DataFrame, groups: DataFrame, buckets: DataFrame, ranks: int, first: int = FIRST) -> DataFrame:
    """lang, source, item, value, rank: the ``ranks`` terms of each group whose p exceeds the language's q by the largest gap, ties by item.

    buckets: lang, source, n, p, low: the least count that the language has among the group's terms of count n. A gap falls as q rises to p, so the
    one with the least q bounds its bucket. A round's best are held against the bounds of what is unopened; a
    group is done where these are strictly below its last rank.
    """
    q = lambda n: probability(n, F.col("lang_total"), F.col("kept"))
    lang = groups.select(*GROUP, "kept", "lang_total")
    low = q(F.col("low"))
    bound = buckets.join(lang, GROUP).withColumn("_q", low).where(F.col("p") > F.col("_q")).select(*GROUP, "n", "p", gap(F.col("p"), F.col("_q")).alias("bound"))
    at = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("bound").desc(), "n"))
    bound = stored(bound.withColumn("at", at), "audit-bounds")
    best_first = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    best, open_, done = None, None, 0
    while True:
        until = done * GROWTH or first
        now = bound.where((F.col("at") > done) & (F.col("at") <= until)).drop("bound", "at")
        if open_ is not None:
            now = now.join(open_, GROUP, "left_semi")
        found = kept.join(now, [*GROUP, "n"]).join(lang, GROUP).withColumn("_q", q(F.col("lang_n"))).where(F.col("p") > F.col("_q"))
        found = found.select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("_q")).alias("value"))
        every = found if best is None else best.drop("rank").unionByName(found)
        best = stored(every.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= ranks), "audit-best")
        last = best.where(F.col("rank") == ranks).select(*GROUP, F.col("value").alias("last"))
        unopened = bound.where(F.col("at") > until).groupBy(*GROUP).agg(F.max("bound").alias("bound"))
        open_ = stored(unopened.join(last, GROUP, "left").where(F.col("last").isNull() | (F.col("bound") >= F.col("last"))).select(*GROUP), "audit-open")
        if open_.isEmpty():
            return best
        done = until


def audit(docs: DataFrame, least_docs: int = 10, ranks: int = 10) -> DataFrame:
    """docs (lang, source, text) -> lang, source, part, item, value, rank. Part ``pair``: how far each other source of the language is; part ``term``: the
    ``ranks`` terms by which a source stands out from its language.

    * Null text, language and source count as empty. A group without terms has its pairs; where a language keeps no term their value is 0.
    * Counts are whole numbers throughout; ties are broken by item in the order of UTF-8. Repeated rows count as often as they occur.
    * An empty table gives no rows. Other columns aren't read.
    * Texts are read once. What is shuffled are counts of (group, term), summed by task before.
    """
    counts = stored(term_counts(docs), "audit-counts")
    kept = stored(postings(counts, least_docs), "audit-postings")
    groups = stored(totals(counts, kept), "audit-groups")
    own = kept.groupBy(*GROUP, "n").agg(F.count(F.lit(1)).alias("terms"), F.min("lang_n").alias("low"))
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    buckets = stored(own.join(groups.select(*GROUP, "total", "kept"), GROUP).select(*GROUP, "n", "terms", "low", p.alias("p")), "audit-buckets")
    pairs = pair_values(kept, groups, buckets)
    by_value = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    terms = top_terms(kept, groups, buckets, ranks)
    return pairs.unionByName(terms.select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank"))
