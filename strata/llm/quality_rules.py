"""Quality rules by host: what fails in each document, how often that happens on its host, and a verdict for the host.

Everything here is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.components import cut

#: White space and symbols of the rules.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: A host fails a rule if its shrunk rate is above this.
HOST_LIMIT = 0.5
#: Weight of the prior, in documents: at least, and at most (hosts that differ by no more than chance).
WEIGHTS = (1.0, 1e6)
#: Rows of a host are spread over so many keys where they meet its verdict.
SALTS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """What fails a document, over the columns of COUNTS. The first two fail it by themselves."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repetition": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "word_length": (n > 0) & ~F.col("word_chars").between(3 * n, 10 * n),
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


BASE = ("few_words", "repetition")


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are sorted with their places, so equal ones are
    neighbours; a place adds the words that the repeated window before it has not covered.
    """
    text = lambda x, i: F.concat_ws(" ", x, F.get(words, i + 1), F.get(words, i + 2))
    windows = F.slice(F.transform(words, text), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))

    def places(ordered: Column) -> Column:
        same = lambda x, k: (x["w"] == F.get(ordered, k - 1)["w"]) | (x["w"] == F.get(ordered, k + 1)["w"])
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        found = F.get(F.transform(F.array(ordered), places), F.lit(0))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(F.aggregate(found, start, step, lambda s: s["n"]))

    return F.get(F.transform(F.array(windows), covered), F.lit(0))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with the columns of COUNTS (longs) over the whole text; a null text counts as empty.

    word_chars: code points in words; n_lines: lines with a word; n_dup_lines: those equal to an earlier line;
    n_repeat_words: words in 3-word windows that occur twice or more. Columns with the name of a new one are replaced.
    """
    taken = {text.lower(), *COUNTS}
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in taken]
    source = F.coalesce(docs[f"`{text}`"], F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(WORD))
    found = lambda b: F.struct(
        F.size(b["words"]).cast("long").alias("n_words"),
        F.length(F.array_join(b["words"], "")).cast("long").alias("word_chars"),
        F.regexp_count(F.array_join(b["words"], " "), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size(b["lines"]).cast("long").alias("n_lines"),
        (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("long").alias("n_dup_lines"),
        _repeated_words(b["words"]).cast("long").alias("n_repeat_words"),
    )
    bound = F.struct(F.regexp_extract_all(source, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    return docs.select(*kept, F.inline(F.transform(F.array(bound), found)))


def host_counts(counted: DataFrame, host: str) -> DataFrame:
    """Per host (not null): `n` documents and how many of them fail each rule. Summed before the shuffle, so a host of
    any size is one row of each task.
    """
    fails = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name) for name, c in rules().items()]
    return counted.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n"), *fails)


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Per rule: mean and weight (a + b) of the beta prior, by moments over the hosts.

    Of the spread of the rates, what chance gives hosts of such sizes is taken off; the rest is the correlation
    inside hosts, 1 / (weight + 1). Only sums over all hosts reach the driver.
    """
    n = F.col("n").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    for name in rules():
        sums += [F.sum(F.col(name).cast("double")).alias(f"k_{name}"), F.sum(F.col(name).cast("double") * F.col(name) / n).alias(f"kk_{name}")]
    row = hosts.agg(*sums).first()
    found = {}
    for name in rules():
        if not row.hosts:
            found[name] = (0.0, WEIGHTS[1])
            continue
        mean = row[f"k_{name}"] / row.n
        chance = mean * (1 - mean)
        room = row.n - row.nn / row.n - (row.hosts - 1)
        shared = 0.0
        if chance > 0 and room > 0:
            shared = ((row[f"kk_{name}"] - row[f"k_{name}"] * mean) / chance - (row.hosts - 1)) / room
        weight = WEIGHTS[1] if shared <= 0 else min(max(1 / shared - 1, WEIGHTS[0]), WEIGHTS[1])
        found[name] = (mean, weight)
    return found


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """`hosts` with the shrunk rate of each rule (`rate_<rule>`) and `failed_rules`, those whose rate is above the limit."""
    prior = priors(hosts)
    rates = {name: (F.col(name) + mean * weight) / (F.col("n") + weight) for name, (mean, weight) in prior.items()}
    failed = F.filter(F.array(*[F.when(rate > limit, F.lit(name)) for name, rate in rates.items()]), lambda x: x.isNotNull())
    return hosts.select("*", *[rate.alias(f"rate_{name}") for name, rate in rates.items()], failed.alias("failed_rules"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """`docs` without its text, with the columns of COUNTS, `base_failed` (fewer than 50 words, or more than half of
    them in repeated windows), `host_failed` (rules that its host fails, a list) and `kept` (neither).

    A host fails a rule if its rate of failing documents, shrunk towards all hosts by an empirical beta prior, is
    above `limit`; a host of few documents is carried by the prior. Documents with a null host are judged by
    themselves and count for no host. Texts are read once and not shuffled: their counts go to the shared
    checkpoint folder. Rows that repeat stay, each with its own count; empty tables give empty results.
    """
    counted = cut(count_words(docs, text).drop("base_failed", "host_failed", "kept"))
    failing = host_verdicts(host_counts(counted, host), limit).where(F.size("failed_rules") > 0)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = failing.select("host", F.col("failed_rules").alias("__failed"), salts.alias("salt"))
    salted = salted.select(F.struct("host", "salt").alias("__theirs"), "__failed")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = counted.withColumn("__own", F.struct(F.col(f"`{host}`").alias("host"), salt.alias("salt")))
    joined = rows.join(salted, F.col("__own") == F.col("__theirs"), "left")
    base = rules()[BASE[0]] | rules()[BASE[1]]
    failed = F.coalesce("__failed", F.array().cast("array<string>"))
    named = [F.col(f"`{c}`") for c in counted.columns]
    return joined.select(*named, base.alias("base_failed"), failed.alias("host_failed")).withColumn("kept", ~F.col("base_failed") & (F.size("host_failed") == 0))
