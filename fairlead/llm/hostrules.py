"""Quality rules on documents and on the hosts they come from; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import SPACE, let, stable, stored

#: Hosts up to this many are broadcast (some 10 MB); beyond, their verdicts are joined by shuffle.
MOST_BROADCAST_HOSTS = 100_000


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _pairs(a: Column, gap: int) -> Column:
    """Hashes of a[i], a[i + gap]."""
    n = F.size(a) - gap
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column, width: int) -> Column:
    """How many positions the windows cover whose hash occurs more than once."""

    def repeated(s: Column) -> Column:
        near = lambda e, k: F.get(s, k)["h"].eqNullSafe(e["h"])
        return F.sort_array(F.filter(F.transform(s, lambda e, k: F.when(near(e, k - 1) | near(e, k + 1), e["i"])), lambda i: i.isNotNull()))

    def length(p: Column) -> Column:
        m = F.size(p) - 1
        steps = F.zip_with(F.slice(p, F.lit(1), m), F.slice(p, F.lit(2), m), lambda a, b: F.least(F.lit(width), b - a))
        return F.aggregate(steps, F.lit(width).cast("long"), lambda total, x: total + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(placed, lambda s: let(repeated(s), length))


def repeated_words(tokens: Column, width: int = 8) -> Column:
    """Words in ``width``-word windows (a power of two) found twice or more in the text, the first included."""

    def doubled(a: Column, gap: int) -> Column:
        if gap < width:
            return let(_pairs(a, gap), lambda b: doubled(b, 2 * gap))
        return F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0).cast("long")).otherwise(_covered(a, width))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) <= width, F.lit(0).cast("long")).otherwise(let(hashed, lambda a: doubled(a, 1)))


def text_measures(text: Column) -> Column:
    """Struct of the rule inputs of a whole text; a null text has no words."""

    def of(tokens: Column) -> Column:
        safe = F.coalesce(text, F.lit(""))
        lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            (F.length(safe) - F.length(F.regexp_replace(safe, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
        )

    return let(word_array(text), of)


def base_rule(measures: str | None = None, fewest_words: int = 20, most_repeated_percent: int = 30) -> Column:
    """Whether measures fail: columns of their own, or a struct of that name."""
    of = lambda name: F.col(f"{measures}.{name}" if measures else name)
    return (of("n_words") < fewest_words) | (100 * of("n_repeat_words") > most_repeated_percent * of("n_words"))


def host_verdicts(measured: DataFrame, host_col: str, most_rate: float = 0.5) -> DataFrame:
    """``(host, host_docs, host_failed, host_rate, host_ok)`` from rows with ``base_failed``.

    A host's failure rate is shrunk towards the corpus by a beta prior fitted to the hosts by moments: mean m of
    all rows, variance v of the hosts' rates (weighted by rows) less what chance alone gives; strength m(1-m)/v - 1,
    held within 1 and 10,000. Null is a host of its own. Two numbers reach the driver.
    """
    hosts = stable(measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")))
    n, f = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("k")).first()
    if not total["n"]:
        alpha, beta = 0.5, 0.5
    else:
        mean = total["f"] / total["n"]
        spread = hosts.agg(F.sum(n * (f / n - mean) * (f / n - mean))).first()[0] / total["n"]
        chance = mean * (1 - mean) * total["k"] / total["n"]
        inner = mean * (1 - mean)
        strength = min(max(inner / max(spread - chance, 1e-9) - 1, 1.0), 1e4) if inner else 1.0
        alpha, beta = mean * strength, (1 - mean) * strength
    return hosts.withColumn("host_rate", (f + F.lit(alpha)) / (n + F.lit(alpha + beta))).withColumn("host_ok", F.col("host_rate") <= most_rate)


def with_host_verdicts(rows: DataFrame, verdicts: DataFrame, host_col: str) -> DataFrame:
    """Join host verdicts back to rows: by broadcast up to a checked number of hosts, else by a join that may split hot hosts."""
    right = verdicts.select(F.col("host").alias("verdict_of"), "host_rate", "host_ok")
    if verdicts.count() <= MOST_BROADCAST_HOSTS:
        right = F.broadcast(right)
    return rows.join(right, F.col(host_col).eqNullSafe(F.col("verdict_of")), "left").drop("verdict_of")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_rate: float = 0.5) -> DataFrame:
    """Measures, base verdict and final verdict of every row (repeated rows too; null texts have no words and fail)."""
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_measures(F.col(text_col)).alias("m")).select("doc_id", "host", "m.*")
    measured = stable(measured.withColumn("base_failed", base_rule()))
    judged = with_host_verdicts(measured, host_verdicts(measured, "host", most_rate), "host")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", most_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, columns as they are.

    Every text is measured once: rows go to the shared folder with their base verdict, those that fail it without
    their columns; hosts are judged from two narrow columns of that, and texts never shuffle.
    """
    measured = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(host_col).alias("of"), text_measures(F.col(text_col)).alias("m"))
    based = measured.select("row", "of", base_rule("m").alias("base_failed"))
    written, _ = stored(based.select("of", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")), "measured", passing=True)
    verdicts = host_verdicts(written.select("of", "base_failed"), "of", most_rate)
    passed = written.where(~F.col("base_failed")).select("row", "of")
    return with_host_verdicts(passed, verdicts, "of").where("host_ok").select("row.*")
