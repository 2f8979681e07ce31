"""Quality rules whose thresholds come from the corpus.

One pass measures every document. For each language and source a mergeable
quantile sketch (KLL) of each measure is built, partially in every task and then
merged, and sketches of sources merge into those of languages and of the whole.
What is read from a group's sketches is drawn towards its language's by ``prior``
documents' weight, and that towards the whole corpus's: a group has a say in
proportion to its size, and no size is a border.

A limit is the median and ``width`` times the distance to the quantile on its clean
side. As faults of a kind push a measure to one side only, the distance is taken on
the other side: a group of which nearly half is junk still has the limit of its
clean half. Nor is it held to be less than the scatter that chance alone gives a text
of median length. Where most documents have none of what is counted, these quantiles are
zero and the sketch's rank of zero tells the rate: with rate r a text of median
length has none with probability exp(-r x length).

A limit is a ratio; what a document may have is a count. So it fails where its count
is beyond chance at the limit: where a Poisson count of the limit's mean reaches it with a probability under
that of ``z`` deviations, shared out over all documents of the group (Chernoff's bound, no term of
which is added to the limit). That leaves short texts alone where a few characters
make a high ratio. As a share of zeros is itself only measured, the rate is that
of its upper bound at z deviations, by the group's size: a group in which none of
a few texts has any still allows some, and one in which none of millions has any hardly
does. No cutoff is fixed. The limits are joined to the measures and decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, stored, whole, with_small

SYMBOLS = "#*$%&|<>"
WINDOW = 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_UPPER, _LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")


@dataclass(frozen=True)
class Measure:
    """A ratio of two counts, and whether low values fail too."""

    name: str
    over: str
    under: str
    both_sides: bool = False

    def column(self) -> Column:
        return F.coalesce(F.try_divide(F.col(self.over).cast("double"), F.col(self.under)), F.lit(0.0))


MEASURES = (
    Measure("symbols", "n_symbols", "word_chars"),
    Measure("capitals", "n_upper", "n_letters"),
    Measure("bangs", "n_bangs", "n_words"),
    Measure("dup_lines", "n_dup_lines", "n_lines"),
    Measure("word_length", "word_chars", "n_words", both_sides=True),
)
UNDER = tuple(dict.fromkeys(m.under for m in MEASURES))
#: What is read from the sketches of a measure: three quantiles, the share of zeros, the median of what it is divided by.
READ = ("below", "median", "above", "zeros", "length")


def repeat_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that occur twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = sum(hashes[k : k + n] * _MIX[k] for k in range(WINDOW))
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # equal windows have equal hashes; whether equal hashes are equal windows is looked up
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(windows, twice)).tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = np.zeros(len(words), bool)
    for at in seen.values():
        if len(at) > 1:
            for k in range(WINDOW):
                covered[np.array(at) + k] = True
    return int(covered.sum())


def measure_text(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LETTERS)),
        text.count("!"),
    )


def measure(docs: DataFrame, keys: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The key columns with the counts of each text; null text has none of anything."""
    names = list(keys)
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), whole(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_text(x.as_py()) for x in batch.column(len(names))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*names, *COUNTS])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(run, fields)


def readings(measured: DataFrame, clean_quantile: float, k: int) -> DataFrame:
    """For each (lang, source), each (lang, null) and (null, null): n and ``r``, an array of READ of each measure.

    The sketches are merged bottom up: no rows are read twice.
    """
    sketched = {m.name: m.column() for m in MEASURES} | {f"by_{c}": F.col(c).cast("double") for c in UNDER}
    own = measured.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(c, F.lit(k)).alias(name) for name, c in sketched.items()))
    own = stored(own, "sketches")  # a sketch draws lots: taken once, so that every use sees the same
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(name).alias(name) for name in sketched)]
    by_lang = own.groupBy("_lang").agg(*merge).withColumn("_source", F.lit(None).cast("string"))
    overall = by_lang.groupBy().agg(*merge).where("n > 0").withColumns({"_lang": F.lit(None).cast("string"), "_source": F.lit(None).cast("string")})
    read = []
    for m in MEASURES:
        read += [F.kll_sketch_get_quantile_double(m.name, F.lit(q)) for q in (clean_quantile, 0.5, 1 - clean_quantile)]
        read += [F.kll_sketch_get_rank_double(m.name, F.lit(0.0)), F.kll_sketch_get_quantile_double(f"by_{m.under}", F.lit(0.5))]
    return stored(own.unionByName(by_lang).unionByName(overall).select("_lang", "_source", "n", F.array(*read).alias("r")), "readings")


def at_most(share: Column, n: Column, z: float) -> Column:
    """Wilson's upper bound of a share that n draws showed."""
    return (share + z * z / (2 * n) + z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def beyond_chance(count: Column, mean: Column, n: Column, z: float) -> Column:
    """Whether none of n Poisson counts of a mean is likely to reach a count: Chernoff's bound, against the tail of z deviations."""
    return (count > mean) & (count * F.log(count / mean) - count + mean > z * z / 2 + F.log(n))


def limits(measured: DataFrame, width: float, clean_quantile: float, k: int, prior: float, z: float = 5.0) -> DataFrame:
    """(lang, source, n, limits): low and high of each measure, for each group of measured."""
    found = readings(measured, clean_quantile, k)
    drawn = lambda n, own, parent: F.zip_with(own, parent, lambda a, b: (n * a + prior * b) / (n + prior))
    overall = found.where(F.col("_lang").isNull()).select(F.col("r").alias("_all"))  # one row at most
    by_lang = found.where(F.col("_source").isNull() & F.col("_lang").isNotNull()).crossJoin(F.broadcast(overall))
    by_lang = by_lang.select(F.col("_lang").alias("_of"), drawn(F.col("n"), F.col("r"), F.col("_all")).alias("_by_lang"))
    own = found.where(F.col("_source").isNotNull()).join(by_lang, F.col("_lang") == F.col("_of"))
    own = own.select("_lang", "_source", "n", drawn(F.col("n"), F.col("r"), F.col("_by_lang")).alias("r"))
    out = []
    for i, m in enumerate(MEASURES):
        below, median, above, zeros, length = (F.get("r", F.lit(len(READ) * i + j)) for j in range(len(READ)))
        if m.both_sides:
            spread = width * F.greatest(F.least(median - below, above - median), median / (2 * F.sqrt(F.greatest(length, F.lit(1.0)))))
            out += [(median - spread).alias(f"low_{m.name}"), (median + spread).alias(f"high_{m.name}")]
        else:
            rate = -F.log(F.greatest(1 - at_most(1 - zeros, F.col("n") + prior, z), F.lit(0.5))) / F.greatest(length, F.lit(1.0))
            out += [F.lit(0.0).alias(f"low_{m.name}"), (median + width * (F.greatest(median - below, F.sqrt(median / F.greatest(length, F.lit(1.0)))) + rate)).alias(f"high_{m.name}")]
    return stored(own.select("_lang", "_source", "n", F.struct(*out).alias("limits")), "limits")


def judge(measured: DataFrame, width: float = 6.0, clean_quantile: float = 0.1, z: float = 5.0, k: int = 200, prior: float = 100.0) -> DataFrame:
    """measured with base_failed, kept, and the names of the rules failed.

    The fixed base comes first (under 10 words, or over a fifth of the words in
    repeated windows); the limits are of documents that pass it.
    """
    measured = measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    found = limits(measured.where(~F.col("base_failed")), width, clean_quantile, k, prior, z)
    sent = found.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.col("limits").alias("_limits"), F.col("n").cast("double").alias("_n"))
    weight = F.length("_l") + F.length("_s") + 16 * len(MEASURES) + 64
    joined = with_small(measured, sent, {"_lang": "_l", "_source": "_s"}, weight, F.xxhash64(*COUNTS))
    rules = []
    for m in MEASURES:
        low, high, under = F.col("_limits")[f"low_{m.name}"], F.col("_limits")[f"high_{m.name}"], F.col(m.under).cast("double")
        if m.both_sides:  # a mean of n lengths, which scatter by about their own mean's half
            chance = z * m.column() / (2 * F.sqrt(F.greatest(under, F.lit(1.0))))
            fails = (m.column() < low - chance) | (m.column() > high + chance)
        else:
            fails = beyond_chance(F.col(m.over), high * under, F.col("_n") + prior, z)
        rules.append(F.when(fails, F.lit(m.name)))
    return joined.withColumn("failed", F.array_compact(F.array(*rules))).select(
        *measured.columns, (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed"
    )


def _keys(docs: DataFrame, id_col: str) -> dict[str, Column]:
    return {"_id": F.col(id_col), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_source": F.coalesce(F.col("source").cast("string"), F.lit(""))}


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row a document: id, the counts, base_failed, kept, failed (names of the rules).

    Needs the columns lang and source; null in either counts as ''. Null text
    counts as empty and fails the base. Repeated rows are judged alike. An empty
    table gives no rows.
    """
    judged = judge(cut(measure(docs, _keys(docs, id_col), text_col)), **params)
    return judged.drop("_lang", "_source").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that pass, columns unchanged, whatever they are called; rows are told apart by id and text.

    Null text, empty text and texts under 10 words fail the base and go; null ids,
    languages and sources are values like others; repeated rows stay or go together.
    An empty table gives an empty table.
    """
    keys = _keys(docs, id_col) | {"_hash": F.xxhash64(whole(text_col))}
    good = judge(cut(measure(docs, keys, text_col)), **params).where("kept").select("_id", "_hash")
    return docs.join(good, docs[id_col].eqNullSafe(good["_id"]) & (F.xxhash64(whole(docs[text_col])) == good["_hash"]), "left_semi")
