"""Operator 2: quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once and stores the measurements with a mask of failure bits. `apply_policy`
turns a mask into a verdict by one AND, so a new policy version never reads the texts again, and
`ablation` counts, from the masks alone, what every policy would keep without each of its rules.

Words are runs of anything but space and tab to carriage return; lines are split at \\n.
Defined results: a null text has no words and no lines with a word, and fails `few_words`. Rows that
repeat are judged one by one. All work is within a row, so no key can be hot and nothing is shuffled
(`ablation` shuffles one count per distinct mask and task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import scratch, text_of

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Fixed order: the bit of a rule is its place here. Append only, or stored masks change their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("shouting", "n_upper > n_lower AND n_upper >= 20"),
    ("exclamations", "4 * n_bangs > n_words"),
    ("duplicate_lines", "n_dup_lines > 5 AND 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("same_words", "n_words >= 50 AND 20 * n_distinct_words < n_words AND n_distinct_words < 100"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: version -> rules that it applies
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": tuple(name for name, _ in RULES),
}


def mask_of(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _chars_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column `quality_`: the measurements that the rules read."""
    t = text_of(F.col(f"`{text}`"))
    bare = F.translate(t, WHITE, "")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    words = F.array_remove(F.split(F.translate(t, WHITE, " " * len(WHITE)), " "), "")
    lines = F.split(t, "\n")
    spoken = F.filter(lines, lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    step = docs.select(
        row.alias("r"),
        F.length(bare).alias("word_chars"),
        _chars_of(bare, "[#*$%&|<>]+").alias("n_symbols"),
        _chars_of(bare, "\\p{Lu}+").alias("n_upper"),
        _chars_of(bare, "\\p{Ll}+").alias("n_lower"),
        _chars_of(bare, "!+").alias("n_bangs"),
        spoken.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
    )
    last = F.size("w") - WINDOW
    step = step.select(
        "r", "word_chars", "n_symbols", "n_upper", "n_lower", "n_bangs",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("w").alias("n_words"),
        F.size(F.array_distinct("w")).alias("n_distinct_words"),
        # windows are compared by a hash of their words' hashes
        F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    rest = [c for c in step.columns if c != "h"]
    step = step.select(
        *rest,
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at")))),
        ).alias("s"),
    )
    at = F.sort_array(
        F.transform(
            F.filter(
                "s",
                lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]),
            ),
            lambda x: x["at"],
        )
    )
    step = step.select(*rest, at.alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    named = [c for c in rest if c != "r"]
    measured = F.struct(*[F.col(c).cast("long").alias(c) for c in named], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return step.select(F.col("r"), measured.alias("m"))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: `r` (its columns, or those named), `m` (the measurements) and `failed` (bit k: rule k fails).

    It is written, so that policies and ablations read stored bits and no rule is evaluated twice.
    """
    measured = measure(docs, text)
    if keep is not None:
        measured = measured.withColumn("r", F.struct(*[F.col("r")[c].alias(c) for c in keep]))
    fields = measured.schema["m"].dataType.fieldNames()
    flat = measured.select("r", "m", *[F.col("m")[f].alias(f) for f in fields])
    failed = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES), F.lit(0))
    return scratch(flat.select("r", "m", failed.cast("long").alias("failed")), "ledger")


def apply_policy(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """rows of a ledger with `kept`: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(rows: DataFrame) -> DataFrame:
    """(policy, without, n_kept): documents that a policy keeps whole (without null) and without each of its rules."""
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p, w, mask_of(p) & ~BIT.get(w, 0)) for p, names in POLICIES.items() for w in (None, *names)]
    sums = [F.sum(F.when(F.col("failed").bitwiseAND(F.lit(mask)) == 0, F.col("n")).otherwise(0)).alias(f"c{k}") for k, (_, _, mask) in enumerate(cases)]
    told = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(w).cast("string").alias("without"), F.coalesce(F.col(f"c{k}"), F.lit(0)).alias("n_kept")) for k, (p, w, _) in enumerate(cases)])
    return counts.agg(*sums).select(F.inline(told))


def keep(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their columns as they were."""
    good = apply_policy(ledger(docs, text), policy).filter("kept")
    return good.select(*[F.col("r")[c].alias(c) for c in docs.columns])
