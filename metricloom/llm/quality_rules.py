"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies and ablations read the bits.

The ledger has one row per document: its measurements and ``failed``, whose bit k is set where rule k fails. A policy is
a named, versioned mask of bits; a document is kept if no bit of the mask is set. So a new version, or the question what
a rule does, needs no text again: ablations count failure masks first, which combine before the shuffle and leave at most
one row for each mask that occurs, and then look at those counts only.

Words are runs of all but blank and tab to carriage return; lines are divided at ``\\n``. A null text is empty; a text
without words has zeros and fails for its length alone. Rows without id stay, repeated rows stay, an empty table gives an
empty ledger. The ledger has columns of its own only, so no name of the input can clash. Everything is a built-in
function of columns; lists are bound once (``_let``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What divides words, and the characters that count as symbols.
_BLANK, SYMBOLS = r"[\x20\x09-\x0D]", "[#*$%&|<>]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, _BLANK + "+"), "")


def _twins(rows: Column, field: str) -> Column:
    """The structs of a list, sorted, that share ``field`` with another."""
    same = lambda x, y: F.get(x, y)[field]      # noqa: E731
    return _let(F.sort_array(rows), lambda own: F.filter(own, lambda x, j: (same(own, j - 1) == x[field]) | (same(own, j + 1) == x[field])))


def _repeated(own: Column, size: int) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more.

    Hashes tell that all windows of a text differ, which ends the matter, or which of them may be equal; those are
    compared as they are.
    """
    window = lambda i: [F.get(own, i + k) for k in range(size)]      # noqa: E731
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - size, F.lit(0))), lambda i: F.xxhash64(*window(i)))
    exact = lambda rows: F.transform(rows, lambda x: F.struct(F.concat_ws(" ", *window(x["i"])).alias("w"), x["i"].alias("i")))      # noqa: E731
    cover = lambda places: F.aggregate(      # noqa: E731
        places, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
        lambda sum_, i: F.struct((sum_["n"] + F.least(F.lit(size), i - sum_["last"])).alias("n"), i.alias("last")), lambda sum_: sum_["n"])

    def among(h):
        likely = _twins(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))), "h")
        places = F.sort_array(F.transform(_twins(exact(likely), "w"), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(cover(places))
    return F.when(F.size(own) < size, F.lit(0)).otherwise(_let(hashes, among))


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct of whole numbers."""
    long = lambda c, name: c.cast("long").alias(name)       # noqa: E731
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))     # noqa: E731
    lines = _let(F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
                 lambda own: F.struct(long(F.size(own), "n"), long(F.size(own) - F.size(F.array_distinct(own)), "dup")))
    found = _let(words(text), lambda own: F.struct(long(F.size(own), "n"), long(_repeated(own, 3), "repeat")))
    return _let(F.struct(found.alias("words"), lines.alias("lines"), F.length(text).alias("length")), lambda x: F.struct(
        x["words"]["n"].alias("n_words"),
        long(without(_BLANK + "+"), "word_chars"),
        long(x["length"] - without(SYMBOLS + "+"), "n_symbols"),
        x["lines"]["dup"].alias("n_dup_lines"),
        x["words"]["repeat"].alias("n_repeat_words"),
        x["lines"]["n"].alias("n_lines"),
        long(x["length"] - without(r"\p{L}+"), "n_letters"),
        long(x["length"] - without("[A-Z]+"), "n_capitals")))


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` (SQL over the measurements) is true."""
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count."""
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in set(self.rules))


#: Bits by place; new rules go to the end, so that old ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "10 * n_letters < 7 * word_chars"),
    Rule("shouting", "2 * n_capitals > word_chars"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("prose", 1, (*BASE.rules, "short_words", "long_words", "symbols")), Policy("prose", 2, tuple(r.name for r in RULES)))


def ledger(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", by: str | None = None) -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (long) of every document; ``by`` names a column to keep as ``group``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    group = [F.col(by).alias("group")] if by else []
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), *group, measurements(text).alias("m")).select("doc_id", *["group"] * bool(by), "m.*")
    bits = [F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules)]
    return found.withColumn("failed", sum(bits[1:], bits[0]) if bits else F.lit(0).cast("long"))


def failed_any(policy: Policy, rules=RULES, bits: str = "failed") -> Column:
    """Whether a document fails a rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def judged(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """The ledger with one flag ``kept_<name>_v<version>`` for each policy."""
    return rows.withColumns({f"kept_{p.name}_v{p.version}": ~failed_any(p, rules) for p in policies})


def ablations(rows: DataFrame, policies=POLICIES, rules=RULES, by: str | None = None) -> DataFrame:
    """What each rule does in each policy, by group if ``by`` is given.

    ``policy, version, rule, n_docs, n_failed`` (fail the rule), ``n_only`` (would be kept without it), ``n_kept`` (by the
    policy), ``n_kept_without`` (by the policy without the rule), and over all documents of the group ``any_bits`` and
    ``all_bits``: rules that some, and that all, documents fail.
    """
    keys = [by] if by else []
    masks = rows.groupBy(*keys, "failed").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"),
                      F.lit(1 << k).cast("long").alias("bit")) for p in policies for k, r in enumerate(rules) if r.name in p.rules]
    seen = masks.select(*keys, "failed", "n", F.inline(F.array(*cases)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("long")      # noqa: E731
    return seen.groupBy(*keys, "policy", "version", "rule", "mask", "bit").agg(
        F.sum("n").alias("n_docs"), count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(hit == F.col("bit")).alias("n_only"),
        count(hit == 0).alias("n_kept"), count((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
        F.bit_or("failed").alias("any_bits"), F.bit_and("failed").alias("all_bits")).drop("mask", "bit")
