"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one long whose bit r is set
when rule r fails. Policies are versioned masks over those bits, so another policy, or the ablation of one
rule, is bit arithmetic on the ledger and never touches the text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import BLANK_CLASS, BLANKS, words_of

#: Bits of a packed (hash, position) pair that hold the position.
POSITION_BITS = 26


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (over the measurement columns) is true."""

    name: str
    fails: str


#: The position of a rule is its bit; append only, so that old ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("exclamation", "100 * n_bangs > 50 * n_words"),
    Rule("upper_case", "100 * n_upper > 50 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "10 * word_chars < 15 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_words")

#: A policy is the set of rules that reject a document; versions are never edited.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE_RULES,
    "full-1": tuple(r.name for r in RULES),
}

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper")


def mask_of(names) -> int:
    bit = {r.name: i for i, r in enumerate(RULES)}
    return reduce(lambda m, n: m | 1 << bit[n], names, 0)


def _repeat_measure(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: words that lie in a three-word window found twice or more in the same text.

    Window hashes are packed with their positions and sorted, so equal windows become neighbours; positions
    whose truncated hash has an equal neighbour are looked at again with the full 64-bit hash. The cost is
    n log n for any text; a text of 2**26 words or more skips the packed step and compares full hashes.
    """
    shift, low = POSITION_BITS, (1 << POSITION_BITS) - 1
    w = F.col(words)
    n = F.size(w)
    df = df.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    h = F.col("_h")
    df = df.withColumn("_p", F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, shift).bitwiseOR(i.cast("long")))))
    p = F.col("_p")
    near = lambda x, i: F.coalesce(F.shiftright(F.get(p, i - 1), shift) == F.shiftright(x, shift), F.lit(False)) | F.coalesce(F.shiftright(F.get(p, i + 1), shift) == F.shiftright(x, shift), F.lit(False))
    found = F.transform(F.filter(p, near), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    df = df.withColumn("_c", F.when(F.size(h) <= low, found).otherwise(F.transform(h, lambda x, i: i)))
    c = F.col("_c")
    df = df.withColumn("_q", F.when(F.size(c) > 1, F.array_sort(F.transform(c, lambda i: F.struct(F.get(h, i).alias("x"), i.alias("i"))))))
    q = F.col("_q")
    same = lambda e, k: F.coalesce(F.get(q, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(q, k + 1)["x"] == e["x"], F.lit(False))
    df = df.withColumn("_i", F.when(q.isNotNull(), F.sort_array(F.transform(F.filter(q, same), lambda e: e["i"]))))
    i = F.col("_i")
    steps = F.aggregate(F.transform(i, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(i, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return df.withColumn(out, F.coalesce(steps, F.lit(0).cast("long"))).drop("_h", "_p", "_c", "_q", "_i")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and the measurements, all long.

    Null and empty texts measure 0 everywhere. Repeated rows are measured each; other columns of the input,
    whatever their names, are not read.
    """
    df = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words_of(F.col("_t")))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("_l", lines)
    only = lambda keep: F.length(F.regexp_replace("_t", keep, ""))
    df = df.select(
        id_col,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", BLANK_CLASS, "")).cast("long").alias("word_chars"),
        only(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        only(r"[^!]+").cast("long").alias("n_bangs"),
        only(r"[^A-Z]+").cast("long").alias("n_upper"),
    )
    return _repeat_measure(df, "_w", "n_repeat_words").select(id_col, *MEASUREMENTS)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits``: bit r is set where RULES[r] fails."""
    m = measure(docs, id_col, text_col)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)])
    # Always 0, but not deterministic, so that a filter on the bits isn't pushed below the measurements and
    # there repeated for every element of their arrays.
    barrier = F.shiftright(F.monotonically_increasing_id(), 63)
    return m.withColumn("fail_bits", bits.bitwiseOR(barrier))


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy fails."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def apply_policies(book: DataFrame, policies=tuple(POLICIES)) -> DataFrame:
    """The ledger with one boolean ``kept_<policy>`` per policy (dashes become underscores)."""
    return book.select("*", *[verdict(p).alias("kept_" + p.replace("-", "_")) for p in policies])


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it rejects, and those that only it rejects.

    The ledger is first summed by its masked bits (at most 2**rules rows whatever the corpus), and each rule
    is then a bit test on those rows. ``seen_bits`` and ``common_bits`` are the OR and AND over rejected rows.
    """
    mask = mask_of(POLICIES[policy])
    by_bits = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if mask >> i & 1])
    rows = by_bits.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("rejected_alone"),
        F.coalesce(F.bit_or(F.when(hit, F.col("bits"))), F.lit(0)).alias("seen_bits"),
        F.coalesce(F.bit_and(F.when(hit, F.col("bits"))), F.lit(0)).alias("common_bits"),
    )


def filter_documents(docs: DataFrame, policy: str = "full-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns as they were.

    The decision is made row by row, so repeated and null ids need no join.
    """
    names = docs.columns
    packed = docs.select(F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    book = ledger(packed, "_row", "_text")
    return book.where(verdict(policy)).select(*[F.col("_row").getField(c).alias(c) for c in names])
