"""String functions on reaction-like strings ('a.b>>c.d'), codes ('1.2.3.4') and JSON literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = ">>"

# The public SMILES token pattern for reactions.
SMILES_TOKENS = r"(\%\([0-9]{3}\)|\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\||\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>>?|\*|\$|\%[0-9]{2}|[0-9])"


def reverse_sides(s: Column) -> Column:
    """Swap the sides around the arrow."""
    return F.array_join(F.reverse(F.split(s, ARROW)), ARROW)


def canonical_components(s: Column) -> Column:
    """Components of each side in sorted order."""
    sides = F.transform(F.split(s, ARROW), lambda x: F.array_join(F.array_sort(F.split(x, r"\.")), "."))
    return F.array_join(sides, ARROW)


def canonical_direction(s: Column) -> Column:
    """The smaller of a string and its reverse: equal for both directions."""
    return F.least(s, reverse_sides(s))


def content_id(s: Column) -> Column:
    return F.sha1(s)


def fractionate(s: Column) -> Column:
    """All components, left side first."""
    return F.split(F.regexp_replace(s, ARROW, "."), r"\.")


def strip_map_numbers(s: Column) -> Column:
    return F.regexp_replace(s, r":[0-9]+\]", "]")


def balanced_fragments(s: Column) -> Column:
    """'.'-fragments, with neighbours rejoined until parentheses balance; what stays open is dropped.

    A rejoined fragment loses its grouping: its first '(' and its last ')'.
    """
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit("."), x))
        even = count(joined, "(") == count(joined, ")")
        return F.struct(
            F.when(even, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"),
            F.when(even, F.lit("")).otherwise(joined).alias("open"),
        )

    parts = F.aggregate(F.split(s, r"\."), start, step, lambda acc: acc["done"])
    grouped = lambda x: F.regexp_replace(F.regexp_replace(x, r"^([^(]*)\(", "$1"), r"\)([^)]*)$", "$1")
    return F.transform(parts, lambda x: F.when(x.contains("."), grouped(x)).otherwise(x))


def side_patterns(s: Column, side: int) -> Column:
    """Patterns of one side of a rule, without map numbers."""
    return balanced_fragments(strip_map_numbers(F.split(s, ARROW)[side]))


def decode_centre(s: Column) -> Column:
    """'1,2;3>>4' as nested integers by side, molecule, atom; empty tokens are dropped."""
    tokens = lambda x, sep: F.filter(F.split(x, sep), lambda t: t != "")
    return F.transform(F.split(s, ARROW), lambda side: F.transform(tokens(side, ";"), lambda m: F.transform(tokens(m, ","), lambda a: a.cast("int"))))


def encode_centre(c: Column) -> Column:
    molecule = lambda m: F.array_join(F.transform(m, lambda a: a.cast("string")), ",")
    return F.array_join(F.transform(c, lambda side: F.array_join(F.transform(side, molecule), ";")), ARROW)


def smiles_tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(SMILES_TOKENS), F.lit(1))


def pad_ids(ids: Column, length: int, pad: int) -> Column:
    """Ids cut to ``length`` and padded up to it."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def drop_components(s: Column, unwanted: list[str]) -> Column:
    return F.array_join(F.filter(F.split(s, r"\."), lambda x: ~x.isin(unwanted)), ".")


def code_prefix(code: Column, levels: int) -> Column:
    return F.array_join(F.slice(F.split(code, r"\."), 1, levels), ".")


def match_level(a: Column, b: Column) -> Column:
    """Number of leading levels that two codes share."""
    same = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.coalesce(x == y, F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda acc, x: F.struct(F.when(acc["on"] & x, acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & x).alias("on"))
    return F.aggregate(same, start, step, lambda acc: acc["n"])


def best_match_level(many: Column, others: Column) -> Column:
    """Largest `match_level` between any codes of two arrays."""
    return F.array_max(F.transform(many, lambda a: F.array_max(F.transform(others, lambda b: match_level(a, b)))))


def trailing_number(s: Column) -> Column:
    return F.regexp_extract(s, r"([0-9]+)$", 1).cast("long")
