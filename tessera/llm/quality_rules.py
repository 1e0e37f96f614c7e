"""Quality rules whose cutoffs are certified to reject few good texts.

A text fails the base when it is short or mostly repeats itself. Beyond that,
rules compare statistics of a text with cutoffs that are chosen per stratum (a
language, say) from labelled texts:

* Labelled texts that pass the base are dealt into two halves by a hash of the
  text, equal texts once. The first half proposes, the second certifies.
* Proposal. For each stratum and rule, the cutoff of level l is the least value
  that at most a share ``LEVELS[l]`` of the good texts exceeds. A level's
  further step is taken only where it rejects a share of the bad texts that is
  ``GAIN`` times that of the good ones; else the cutoff stays where it was. So
  levels are nested: what one rejects, the next rejects too.
* Certificate. At level l a stratum rejects k of the n good texts of the second
  half, by any rule. The hypothesis "more than ``limit`` of its good texts are
  rejected" is tested with the exact binomial distribution. Levels are tested
  from the mildest, stopping at the first that is not rejected (a fixed
  sequence needs no correction), each at ``risk`` divided by the number of
  strata (Bonferroni). With probability 1 - ``risk`` no stratum's chosen level
  rejects more than ``limit`` of its good texts.

A stratum with too few labelled texts has no certificate and rejects nothing
beyond the base: with limit 0.05 and risk 0.05 over four strata it takes 86
good texts in the second half.

Scale. One narrow pass over the texts gives a row of numbers each, stored once.
All labelled rows count. Proposals need the number of good and bad texts per
stratum, rule and value, values being rounded to three digits; so what one task
gets of a group is bounded by the digits, not by the rows. Nothing is collected
to the driver but the number of strata; cutoffs are looked up by stratum, which
spreads a stratum that holds a third of all rows.

Defined cases. A null text has no words. A null stratum is the empty string.
Texts without a label propose nothing; ids that ``labels`` repeats with both
verdicts count as both. Null ids have no label. An empty table gives an empty
result, and without labels the base alone decides. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import checkpointed, looked_up, stored

SYMBOLS = b"#*$%&|<>"
#: Shares of good texts that a rule alone may exceed, mildest first, and how much larger a share of the bad ones a step must take.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
GAIN = 10.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rules: statistics of a text with words, larger ones worse.
RULES: dict[str, str] = {
    "symbols": "n_symbols / word_chars",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "n_words / word_chars",
}


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a stretch of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    two = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # three ids would not fit a number
        two = np.unique(two, return_inverse=True)[1]
    _, which, times = np.unique(two[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    held = np.zeros(len(words), bool)
    for i in range(3):
        held[i : len(words) - 2 + i] |= again
    return int(held.sum())


def counts(text: str) -> tuple[int, ...]:
    """``COUNTS`` of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at the bytes 0x20 and 0x09 to 0x0D
    points = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    return len(words), int(((points & 0xC0) != 0x80).sum()), symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """(id, stratum, same, ``COUNTS``, base_failed) of every row; ``same`` is a hash of the text."""
    rows = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = np.array([counts(t.as_py() or "") for t in part.column("text")], np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(found[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "stratum", "same")] + columns, names=["id", "stratum", "same", *COUNTS])

    out = rows.mapInArrow(count, f"id {kind}, stratum string, same bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def three_digits(x: Column) -> Column:
    """``x`` rounded down to three digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 2)
    return F.when(x > 0, F.floor(x / unit) * unit).otherwise(0.0)


def with_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rows`` with each rule's statistic; 0 for texts without words."""
    return rows.withColumns({f"rule_{n}": F.when(F.col("n_words") > 0, three_digits(F.expr(x))).otherwise(0.0) for n, x in rules.items()})


def proposed(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[float]:
    """The cutoff of each level, from the good and bad texts of each value; texts above a cutoff are rejected."""
    order = np.argsort(-value, kind="stable")
    value, good, bad = value[order], good[order], bad[order]
    goods, bads = max(1, good.sum()), max(1, bad.sum())
    # Above value[i] are the texts before place i.
    above_good, above_bad = np.concatenate(([0], np.cumsum(good))), np.concatenate(([0], np.cumsum(bad)))
    at, out = 0, []
    for share in LEVELS:
        to = int(np.searchsorted(above_good, share * goods, side="right")) - 1
        more_good, more_bad = above_good[to] - above_good[at], above_bad[to] - above_bad[at]
        if more_bad > 0 and more_bad / bads >= GAIN * more_good / goods:
            at = to
        # Everything exceeds a cutoff under the least value: none rejects all.
        out.append(float(value[at]) if 0 < at < len(value) else math.inf if at == 0 else float(value[-1]))
    return out


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, for k below its mean; 1 from there on."""
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        if term < 1e-18 * total:
            break
    return min(1.0, total)


def certified(rejected: list[int], n: int, limit: float, risk: float) -> int:
    """The last level of the sequence that is certified, -1 if not even the first is; ``rejected`` are good texts by level."""
    for level, k in enumerate(rejected):
        if at_most(k, n, limit) > risk:
            return level - 1
    return len(rejected) - 1


def _withheld(cuts: str, value: Column) -> Column:
    """The cutoffs that ``value`` does not exceed, which are those of the first levels."""
    return F.filter(cuts, lambda c: c >= value)


def _depth(rules: dict[str, str]) -> Column:
    """The first level that rejects a row, the number of levels if none does."""
    return F.array_min(F.array(*[F.size(_withheld(f"cut_{n}", F.col(f"rule_{n}"))) for n in rules]))


def learned(labelled: DataFrame, rules: dict[str, str], limit: float, risk: float) -> DataFrame:
    """(stratum, cut_<rule> ARRAY<DOUBLE> by level, level, n_good, rejected): what each stratum's labelled texts propose and certify.

    ``labelled`` has a row for each different text: stratum, same, quality and
    the rules' statistics.
    """
    first = F.pmod(F.col("same"), F.lit(2)) == 0
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"rule_{n}").alias("value")) for n in rules])).alias("r")
    of = lambda q: F.count_if(F.col("quality") == q)
    values = labelled.filter(first).select("stratum", "quality", each).groupBy("stratum", "r.rule", "r.value").agg(of(1).alias("good"), of(0).alias("bad"))

    def propose(group: pd.DataFrame) -> pd.DataFrame:
        cuts = proposed(group["value"].to_numpy(), group["good"].to_numpy(), group["bad"].to_numpy())
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "rule": group["rule"].iloc[:1], "cuts": [cuts]})

    cuts = values.groupBy("stratum", "rule").applyInPandas(propose, "stratum string, rule string, cuts array<double>")
    wide = checkpointed(cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == n, F.col("cuts"))).alias(f"cut_{n}") for n in rules]))
    sizes = labelled.groupBy("stratum").agg(F.count("*").alias("n"))
    second = labelled.filter(~first & (F.col("quality") == 1))
    second = looked_up(second, wide.join(sizes, "stratum"), "stratum", "n").filter(F.col(f"cut_{next(iter(rules))}").isNotNull())
    found = checkpointed(second.groupBy("stratum", _depth(rules).alias("depth")).agg(F.count("*").alias("n")))
    strata = max(1, found.select("stratum").distinct().count())

    def certify(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        rejected = [int(group["n"][group["depth"] <= i].sum()) for i in range(len(LEVELS))]
        level = certified(rejected, n, limit, risk / strata)
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "level": [level], "n_good": [n], "rejected": [rejected[level] if level >= 0 else 0]})

    levels = found.groupBy("stratum").applyInPandas(certify, "stratum string, level int, n_good bigint, rejected bigint")
    return wide.join(levels, "stratum")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_id: str = "doc_id",
    label_col: str = "quality",
    rules: dict[str, str] | None = None,
    limit: float = 0.05,
    risk: float = 0.05,
) -> DataFrame:
    """One row per row: id, stratum, ``COUNTS``, base_failed, kept."""
    rules = RULES if rules is None else rules
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    rows = with_rules(stored(measured(docs, id_col, text_col, stratum)), rules)
    said = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("quality")).filter("quality IN (0, 1)").distinct()
    statistics = [f"rule_{n}" for n in rules]
    passing = rows.filter(~F.col("base_failed")).groupBy("id", "stratum", "same", *statistics).agg(F.lit(1))
    labelled = checkpointed(passing.join(said, "id").select("stratum", "same", "quality", *statistics).distinct())
    model = learned(labelled, rules, limit, risk)
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    told = looked_up(rows, model.join(sizes, "stratum").drop("n_good", "rejected"), "stratum", "n")
    rejected = F.coalesce(_depth(rules) <= F.col("level"), F.lit(False))
    return told.select(F.col("id").alias(id_col), "stratum", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
