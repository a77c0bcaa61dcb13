"""
Quality by weak supervision: rules vote for a text, against it or not at all.

No rule decides. Expectation-maximisation over the vote patterns of all documents estimates
how large a share is good, and how each rule votes on good and on bad texts; a document's
posterior probability of being good follows from its votes. There are at most three to the
number of rules patterns, so the estimate is one row of array functions, whatever the corpus.
Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere.llm.common import WORD_GAP, texts
from gridmere.session import materialise

#: The rules: a vote for the text, and one against it, as conditions on whole numbers. What
#: meets neither is an abstention. n_other counts characters that are neither letters nor blanks.
RULES = {
    "few_symbols": ("200 * n_symbols <= word_chars", "50 * n_symbols > word_chars"),
    "letters": ("100 * n_other <= 8 * word_chars", "100 * n_other > 16 * word_chars"),
    "word_length": (
        "10 * word_chars BETWEEN 42 * n_words AND 62 * n_words",
        "10 * word_chars NOT BETWEEN 35 * n_words AND 70 * n_words",
    ),
    "few_capitals": ("100 * n_upper <= 12 * word_chars", "100 * n_upper > 30 * word_chars"),
    "new_words": ("100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 30 * n_words"),
    "new_lines": ("20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
}
ROUNDS = 20
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """
    Counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
    n_lines (with a word), n_upper and n_other. Null and empty texts count zero.
    """
    blank = "[\\x20\\x09-\\x0D]"
    base = texts(docs, doc_id, text).select(
        "doc_id",
        F.array_remove(F.split("text", WORD_GAP), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        (F.length("text") - F.regexp_count("text", F.lit(blank))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[^\\p{L}\\x20\\x09-\\x0D]")).cast("long").alias("n_other"),
    )
    counted = base.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_other", "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    runs = counted.withColumn(
        "runs",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("words")
    placed = runs.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("runs")) < F.size("runs"),
            F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("runs")

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    covered = F.flatten(
        F.transform(F.filter("placed", repeated), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    )
    n_repeat = F.when(F.col("placed").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))
    return placed.withColumn("n_repeat_words", n_repeat.cast("long")).drop("placed")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> Column:
    """One of 1, -1 and 0 (abstains) for each rule."""
    return F.array(
        *[F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for good, bad in RULES.values()]
    )


def _log_odds(ballot: Column, model: Column) -> Column:
    """Of good against bad, given the votes and how each rule votes on either kind."""

    def weight(j: int) -> Column:
        good, bad = model["good"][j], model["bad"][j]
        return (
            F.when(ballot[j] == 1, F.log(good / (1 - bad)))
            .when(ballot[j] == -1, F.log((1 - good) / bad))
            .otherwise(F.lit(0.0))
        )

    terms = [weight(j) for j in range(len(RULES))]
    return reduce(lambda a, b: a + b, terms, F.log(model["prior"] / (1 - model["prior"])))


def _probability(ballot: Column, model: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(ballot, model)))


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def vote_model(ballots: DataFrame) -> DataFrame:
    """
    One row `model`: the share of good texts (prior), and of each rule's votes on good texts those
    for them (good), on bad texts those against them (bad). Starts from 0.8 for all.
    """
    patterns = ballots.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    rules = range(len(RULES))

    def total(weighted: Column, value) -> Column:
        return F.aggregate(weighted, F.lit(0.0), lambda a, p: a + value(p))

    def share(weighted: Column, j: int, vote: int, mass) -> Column:
        """Of the votes of rule j, those that are `vote`; one vote of either kind is added."""
        hit = total(weighted, lambda p: F.when(p["votes"][j] == vote, mass(p)).otherwise(F.lit(0.0)))
        cast = total(weighted, lambda p: F.when(p["votes"][j] != 0, mass(p)).otherwise(F.lit(0.0)))
        return (hit + 1) / (cast + 2)

    def step(model: Column, _: Column) -> Column:
        def of(weighted: Column) -> Column:
            def good_mass(p: Column) -> Column:
                return p["n"] * p["q"]

            def bad_mass(p: Column) -> Column:
                return p["n"] * (1 - p["q"])

            good, everything = total(weighted, good_mass), total(weighted, lambda p: p["n"] * F.lit(1.0))
            return F.struct(
                ((good + 1) / (everything + 2)).alias("prior"),
                F.array(*[share(weighted, j, 1, good_mass) for j in rules]).alias("good"),
                F.array(*[share(weighted, j, -1, bad_mass) for j in rules]).alias("bad"),
            )

        weighted = F.transform(
            "patterns",
            lambda p: F.struct(
                p["votes"].alias("votes"), p["n"].alias("n"), _probability(p["votes"], model).alias("q")
            ),
        )
        return _bound(weighted, of)

    start = F.struct(
        F.lit(0.8).alias("prior"),
        F.array(*[F.lit(0.8) for _ in rules]).alias("good"),
        F.array(*[F.lit(0.8) for _ in rules]).alias("bad"),
    )
    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("model"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at: float = 0.5) -> DataFrame:
    """
    One row per row of `docs`: doc_id, the counts, base_failed (too short or too repetitive for any
    verdict), quality (posterior probability of being good) and kept.

    The rules' reliability is estimated on all texts that pass the base test. Null and empty
    texts fail it. Repeated rows vote and come back as often; a null doc_id stays null. If
    no text passes, the estimate is the start values, and nothing is kept.
    """
    counts = materialise(
        text_counts(docs, doc_id, text).withColumn("base_failed", base_failed()).withColumn("votes", votes()),
        "counts",
    )
    model = vote_model(counts.where(~F.col("base_failed")).select("votes"))
    judged = counts.withColumn("model", model.scalar())
    judged = judged.withColumn("quality", _probability(F.col("votes"), F.col("model")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("quality") >= at, F.lit(False))
    return judged.select(
        "doc_id", *_BASE, "base_failed", kept.alias("kept"), F.round("quality", 6).alias("quality")
    )


def oracle_sql(at: float = 0.5) -> str:
    """The same in plain SQL, with one step of the estimate after the other written out."""
    names = [f"v{j}" for j in range(len(RULES))]
    ballots = ", ".join(
        f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS {v}"
        for v, (good, bad) in zip(names, RULES.values(), strict=True)
    )
    weights = " + ".join(
        f"CASE {v} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN -1 THEN ln((1 - g{j}) / b{j}) ELSE 0 END"
        for j, v in enumerate(names)
    )
    probability = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {weights})))"
    start = ", ".join(f"0.8e0 AS g{j}, 0.8e0 AS b{j}" for j in range(len(names)))
    steps = [f"m0 AS (SELECT 0.8e0 AS prior, {start})"]
    shares = ", ".join(
        f"(coalesce(sum(n * q) FILTER (WHERE {v} = 1), 0) + 1) / (coalesce(sum(n * q) FILTER (WHERE {v} <> 0), 0) + 2) AS g{j}, "
        f"(coalesce(sum(n * (1 - q)) FILTER (WHERE {v} = -1), 0) + 1) / (coalesce(sum(n * (1 - q)) FILTER (WHERE {v} <> 0), 0) + 2) AS b{j}"
        for j, v in enumerate(names)
    )
    for k in range(1, ROUNDS + 1):
        steps.append(
            f"m{k} AS (SELECT (sum(n * q) + 1) / (sum(n) + 2) AS prior, {shares} "
            f"FROM (SELECT p.*, {probability} AS q FROM p, m{k - 1}))"
        )
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   list_filter(string_split_regex(coalesce(text, ''), '{WORD_GAP}'), lambda x: x <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
            FROM documents
        ),
        r AS (SELECT doc_id, i, w[i:i + 2] AS run
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        rep AS (
            SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos
                  FROM r JOIN (SELECT doc_id, run FROM r GROUP BY ALL HAVING count(*) > 1) USING (doc_id, run))
            GROUP BY doc_id
        ),
        c AS (
            SELECT doc_id, len(w)::BIGINT AS n_words,
                   length(regexp_replace(t, '{blank}', '', 'g'))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
                   (length(t) - length(regexp_replace(t, '[^\\p{{L}}\\x20\\x09-\\x0D]', '', 'g')))::BIGINT AS n_other,
                   len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM d LEFT JOIN rep USING (doc_id)
        ),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ballots} FROM c),
        p AS (SELECT {", ".join(names)}, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL),
        {", ".join(steps)}
        SELECT doc_id, {", ".join(_BASE)}, base_failed,
               NOT base_failed AND {probability} >= {at} AS kept, round({probability}, 6) AS quality
        FROM b, m{ROUNDS}
    """
