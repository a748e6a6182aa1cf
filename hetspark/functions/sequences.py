"""Column expressions on DNA strings over acgt and on structure names such as AAB."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def dna(text: Column) -> Column:
    """The letters a, c, g and t of a text, lower-cased."""
    return F.regexp_replace(F.lower(text), "[^acgt]+", "")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "acgt", "tgca")


def canonical(seq: Column) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(seq, reverse_complement(seq))


#: Bases that two bits each fit a long.
LONGEST = 31


def encode(seq: Column) -> Column:
    """Two bits a base (a 0, c 1, g 2, t 3), first base highest, in a long: up to LONGEST bases."""
    return F.conv(F.translate(seq, "acgt", "0123"), 4, 10).cast("bigint")


#: Words of so many letters are looked up when codes are spelled out.
SPELLED = 4


def decode(code: Column, k: int) -> Column:
    table = F.lit(["".join(x) for x in product("acgt", repeat=SPELLED)])
    parts = [F.get(table, F.shiftrightunsigned(code, by).bitwiseAND(F.lit(4**SPELLED - 1)).cast("int")) for by in range(2 * SPELLED * ((k - 1) // SPELLED), -1, -2 * SPELLED)]
    return F.substring(F.concat(*parts), SPELLED * len(parts) - k + 1, k)


def word_bounds(k: int) -> list[tuple[int, int]]:
    """(first base, bases) of the longs that a k-mer's code is made of."""
    return [(at, min(LONGEST, k - at)) for at in range(0, k, LONGEST)]


def code_words(code: Column, k: int) -> list[Column]:
    """The longs of a code, the first bases first."""
    return [code] if k <= LONGEST else [code[f"w{i}"] for i in range(len(word_bounds(k)))]


def code_from(words: list[Column]) -> Column:
    return words[0] if len(words) == 1 else F.struct(*(w.alias(f"w{i}") for i, w in enumerate(words)))


def code_of(kmer: Column, k: int) -> Column:
    """What stands for a k-mer in joins: its long, or a struct of longs where k is over LONGEST. Both sort like k-mers."""
    return code_from([encode(F.substring(kmer, at + 1, n)) for at, n in word_bounds(k)]) if k > LONGEST else encode(kmer)


def kmer_of(code: Column, k: int) -> Column:
    return F.concat(*(decode(w, n) for w, (_, n) in zip(code_words(code, k), word_bounds(k), strict=True))) if k > LONGEST else decode(code, k)


def n_of(letter: str, text: Column) -> Column:
    """How often one letter stands in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def least_base(*seqs: Column) -> Column:
    """The number of the rarest base in sequences taken together."""
    return F.least(*(sum((n_of(b, s) for s in seqs), F.lit(0)) for b in "acgt"))


def collapse_runs(seq: Column) -> Column:
    """Runs of one base as a single base."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def structure(a: Column, b: Column) -> Column:
    """AAB from 2 and 1."""
    return F.concat(_repeat("A", a), _repeat("B", b))


def _repeat(letter: str, n: Column) -> Column:
    return F.repeat(F.lit(letter), n.cast("int"))


def short_structure(a: Column, b: Column) -> Column:
    """2A1B from 2 and 1."""
    return F.concat(a.cast("int").cast("string"), F.lit("A"), b.cast("int").cast("string"), F.lit("B"))


def reduced_structure(name: Column) -> Column:
    """Names of over four letters in the short form, others as they are."""
    return F.when(F.length(name) > 4, short_structure(n_of("A", name), n_of("B", name))).otherwise(name)
