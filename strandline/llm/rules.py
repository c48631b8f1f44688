"""Quality rules whose votes are weighed by weak supervision; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import settle

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: What a line of prose may end with.
STOPS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "。", "！", "？")
SPAN = 5
N_RULES = 8
#: Shares of votes (bad, abstain, good) by good and by bad documents, and the share of good documents, before any vote is seen.
OF_GOOD, OF_BAD, PRIOR = (0.02, 0.18, 0.8), (0.4, 0.3, 0.3), 0.9
#: What these count for, as a share of the documents.
BELIEF = 0.001


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though a lambda in body uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of SPAN words found twice or more. Windows are sorted by hash, so that equal ones are neighbours."""
    def windows(h: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(SPAN)]).alias("h"), i.alias("i")))
        return F.array_sort(hashed)

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(SPAN), F.coalesce(F.get(at, k + 1) - x, F.lit(SPAN)))), F.lit(0), lambda a, b: a + b)

    full = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), lambda s: let(twice(s), covered)))
    return F.when(F.size(words) > SPAN, full).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the base measures and those that only rules use, in the struct `m`."""
    text = F.coalesce(docs[text_col], F.lit(""))
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(without(text, BLANKS)).cast("long").alias("word_chars"), (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("of_lines"), repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), (F.length(text) - F.length(without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        )

    def of_lines(x: Column) -> Column:
        ended = F.filter(x, lambda y: F.substring(F.rtrim(y, F.lit(BLANKS)), -1, 1).isin(*STOPS))
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"), F.size(ended).cast("long").alias("n_ended"))

    out = docs.withColumn("m", let(words, measured))
    return out.withColumn("m", F.struct(*[F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_distinct", "n_upper")], "m.of_lines.*"))


def votes() -> Column:
    """All votes of a document as one number: digit r to the base 3 is rule r's vote, 0 bad, 1 abstains, 2 good. Rules are on shares, so long texts are judged like short ones."""
    n, m = F.col("m.n_words"), F.col("m")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    mean = m["word_chars"] / F.greatest(n, F.lit(1))
    rules = [
        vote(n >= 50, n > 100_000),
        vote((mean >= 3) & (mean <= 7), (mean < 2) | (mean > 10)),
        vote(m["n_symbols"] * 50 <= n, m["n_symbols"] * 10 > n),
        vote(m["n_upper"] * 6 <= m["word_chars"], m["n_upper"] * 2 > m["word_chars"]),
        vote((m["n_dup_lines"] * 10 <= m["n_lines"]) & (m["n_lines"] >= 3), m["n_dup_lines"] * 10 > m["n_lines"] * 3),
        vote(m["n_repeat_words"] * 20 <= n, m["n_repeat_words"] * 7 > n),
        vote((m["n_distinct"] * 2 >= n) & (n >= 20), m["n_distinct"] * 8 < n),
        vote(m["n_ended"] * 10 >= m["n_lines"] * 9, m["n_ended"] * 2 < m["n_lines"]),
    ]
    code = rules[0]
    for r, v in enumerate(rules[1:], start=1):
        code = code + v * 3**r
    return code.cast("int")


def evidence(v: Column, model: Column) -> Column:
    """Log-odds that a document with the votes v (array) is good."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(N_RULES - 1)), model["odds"], lambda a, r: a + F.get(model["weight"], 3 * r + F.get(v, r)))


def weight(c: Column, good: Column, bad: Column) -> Column:
    """What the vote c % 3 tells: log of its shares' ratio. A vote is never taken for its opposite; what an abstention tells is left to the data."""
    ratio = F.ln(good) - F.ln(bad)
    return F.when(c % 3 == 0, F.least(ratio, F.lit(0.0))).when(c % 3 == 2, F.greatest(ratio, F.lit(0.0))).otherwise(ratio)


def learned(patterns: Column, rounds: int) -> Column:
    """Weights of all votes and the prior log-odds by expectation-maximisation over vote patterns (array of struct<v, n>).

    Each rule has shares of its three votes among good and among bad documents. A rule that says good to nearly all thus
    tells little, however many such rules agree, and one that seldom objects tells much when it does.
    """
    each = F.sequence(F.lit(0), F.lit(3 * N_RULES - 1))

    def fixed(values: tuple, c: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), c % 3)

    start = F.struct(F.transform(each, lambda c: weight(c, fixed(OF_GOOD, c), fixed(OF_BAD, c))).alias("weight"), F.ln(F.lit(PRIOR / (1 - PRIOR))).alias("odds"))

    def total(patterns: Column, of) -> Column:
        return F.aggregate(patterns, F.lit(0.0), lambda a, x: a + x["n"] * of(x))

    def step(state: Column, _: Column) -> Column:
        def better(p: Column) -> Column:
            return let(F.struct(total(p, lambda x: x["g"]).alias("good"), total(p, lambda x: 1 - x["g"]).alias("bad")), lambda s: let(BELIEF * (s["good"] + s["bad"]) + 1, lambda k: F.struct(
                F.transform(each, lambda c: weight(
                    c,
                    (total(F.filter(p, lambda x: F.get(x["v"], F.floor(c / 3).cast("int")) == c % 3), lambda x: x["g"]) + k * fixed(OF_GOOD, c)) / (s["good"] + k),
                    (total(F.filter(p, lambda x: F.get(x["v"], F.floor(c / 3).cast("int")) == c % 3), lambda x: 1 - x["g"]) + k * fixed(OF_BAD, c)) / (s["bad"] + k),
                )).alias("weight"),
                let(F.least(F.lit(0.99), F.greatest(F.lit(0.5), (s["good"] + PRIOR * k) / (s["good"] + s["bad"] + k))), lambda x: F.ln(x / (1 - x))).alias("odds"),
            )))

        return let(F.transform(patterns, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (1 / (1 + F.exp(-evidence(x["v"], state)))).alias("g"))), better)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def judged(docs: DataFrame, text_col: str, rounds: int = 20) -> DataFrame:
    """docs without the text, with m (measures), base_failed, posterior and kept. Texts are measured once and the measures
    written, as both the model and the verdicts need them. The model comes from all documents that the base does not
    fail, as counts of vote patterns: 3 ** N_RULES rows at most, which is also the bound of what is broadcast."""
    names = [c for c in docs.columns if c != text_col]
    failed = (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    scored = settle(measures(docs, text_col).withColumn("code", votes()).withColumn("base_failed", failed).select(*names, "m", "code", "base_failed"), "rules")
    digits = F.array(*[(F.floor(F.col("code") / 3**r) % 3).cast("int") for r in range(N_RULES)])
    patterns = scored.groupBy("code").agg(F.sum(F.when(F.col("base_failed"), 0.0).otherwise(1.0)).alias("n")).select("code", digits.alias("v"), "n")
    # One row of the patterns, sorted, as sums of doubles depend on the order.
    model = patterns.agg(F.array_sort(F.collect_list(F.struct("code", "v", "n"))).alias("p")).select("p", learned(F.col("p"), rounds).alias("model"))
    verdicts = model.select(F.explode("p").alias("x"), "model").select(F.col("x.code").alias("_code"), F.round(1 / (1 + F.exp(-evidence(F.col("x.v"), F.col("model")))), 6).alias("posterior"))
    out = scored.join(F.broadcast(settle(verdicts, "verdicts")), scored["code"] == F.col("_code"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop("code", "_code")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base measures, base_failed, posterior, kept.

    A null text has no words and no lines, like an empty one; it fails. Ids may be null or repeat. Other columns
    are not read. An empty table gives no rows.
    """
    out = judged(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *[F.col(f"m.{c}").alias(c) for c in base], "base_failed", "posterior", "kept")


def drop_bad(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, without the rows that are not kept."""
    whole = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return judged(whole, "text").where("kept").select("row.*")
