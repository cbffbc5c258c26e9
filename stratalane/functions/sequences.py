"""Columns over sequences, qualities and alleles: built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def count_of(seq: Column | str, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(_c(seq)) - F.length(F.translate(_c(seq), characters, ""))


def gc_fraction(seq: Column | str) -> Column:
    """GC over all bases that are known; null where none is."""
    gc, at = count_of(seq, "GCgc"), count_of(seq, "ATUatu")
    return F.try_divide(gc, gc + at)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places over the shorter length."""
    pairs = F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def chunks(seq: Column | str, size: int) -> Column:
    """A sequence in pieces of `size`, the last one shorter. Windows are put together from these, as looking places up
    in a long text one by one would walk it from its beginning each time."""
    return F.regexp_extract_all(_c(seq), F.lit(f"[\\s\\S]{{1,{size}}}"), F.lit(0))


def window_counts(seq: Column | str, characters: str, size: int, step: int, last_full: bool = True) -> Column:
    """array<struct<start, n>>: how many of the characters each window has; starts are 0-based. Without last_full the
    window that ends with the sequence is left out."""
    unit = gcd(size, step)
    counts = F.transform(chunks(seq, unit), lambda c: count_of(c, characters))
    room = F.length(_c(seq)) - size - (0 if last_full else 1)
    starts = F.when(room >= 0, F.sequence(F.lit(0), room, F.lit(step))).otherwise(F.array().cast("array<int>"))
    add = lambda a, x: a + x
    every = lambda n: F.transform(starts, lambda s: F.struct(s.alias("start"), F.aggregate(F.slice(n, (s / unit).cast("int") + 1, size // unit), F.lit(0), add).alias("n")))
    return F.get(F.transform(F.array(counts), every), F.lit(0))


def shreds(seq: Column | str, size: int = 900, overlap: int = 300) -> Column:
    """0-based starts of overlapping pieces; the first piece that reaches the end is the last."""
    n, step = F.length(_c(seq)), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)) * step
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def kept_length(qual: Column | str, offset: int = 33, good: int = 28, least: int = 12, fails: int = 10) -> Column:
    """Length left by quality trimming: reading ends at a base of at most `least` or at failure number fails + 1 below
    `good`, and the failing run there is cut off."""
    q = F.transform(F.split(_c(qual), ""), lambda c: F.ascii(c) - offset)
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("kept"), F.lit(0).alias("failed"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        failed = a["failed"] + F.when(x < good, 1).otherwise(0)
        over = (x < good) & ((x <= least) | (failed > fails))
        return F.when(a["over"], a).otherwise(F.struct((a["i"] + 1).alias("i"), F.when(x >= good, a["i"] + 1).otherwise(a["kept"]).alias("kept"), failed.alias("failed"), over.alias("over")))

    return F.aggregate(q, zero, step, lambda a: a["kept"])


def encoding(qual: Column | str) -> Column:
    """33 or 64 where a read's qualities tell, null where they don't."""
    q = F.transform(F.split(_c(qual), ""), F.ascii)
    low, high = F.size(F.filter(q, lambda x: x < 59)), F.size(F.filter(q, lambda x: x > 74))
    return F.when((low > 2) & (high == 0), 33).when((high > 2) & (low == 0), 64)


def requalified(qual: Column | str, shift: int = 31) -> Column:
    """Qualities moved from an offset of 33 + shift to 33."""
    source = "".join(chr(c) for c in range(33 + shift, 127))
    return F.translate(_c(qual), source, "".join(chr(ord(c) - shift) for c in source))


def from_solexa(qual: Column | str) -> Column:
    """Solexa odds (offset 64, from -5) to phred at offset 33: 10 log10(1 + 10^(q / 10)), rounded."""
    from math import log10

    source = [chr(64 + q) for q in range(-5, 63)]
    target = [chr(int(33 + 10 * log10(1 + 10 ** (q / 10)) + 0.499)) for q in range(-5, 63)]
    return F.translate(_c(qual), "".join(source), "".join(target))


def cut(seq: Column | str, front: int = 0, longest: int | None = None, tail: int | None = None) -> Column:
    """Without the first bases, then at most `longest` or the last `tail` of them."""
    out = F.substr(_c(seq), F.lit(front + 1))
    if tail is not None:
        out = F.right(out, F.lit(tail))
    return out if longest is None else F.substr(out, F.lit(1), F.lit(longest))


def wrapped(seq: Column | str, width: int = 60) -> Column:
    return F.regexp_replace(_c(seq), f"(.{{{width}}})(?=.)", "$1\n")


def standard_header(name: Column | str, suffix: str | None = None) -> Column:
    """Up to the first blank, without a mate number, with a mate number of ours."""
    bare = F.regexp_replace(F.regexp_replace(_c(name), r"\s[\s\S]*$", ""), r"[/:]\d$", "")
    return bare if suffix is None else F.concat(bare, F.lit("/" + suffix))


#: The standard genetic code: bases in the order TCAG, amino acids by codon.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translated(seq: Column | str) -> Column:
    """Amino acids of the whole codons of a sequence; X for a codon with anything but ACGT."""
    s = F.upper(_c(seq))
    place = lambda c: F.instr(F.lit("TCAG"), c)
    n = F.floor(F.length(s) / 3).cast("int")

    def amino(k: Column) -> Column:
        a, b, c = (place(F.substr(s, 3 * k + i, F.lit(1))) for i in (1, 2, 3))
        return F.when((a > 0) & (b > 0) & (c > 0), F.substr(F.lit(CODE), 16 * (a - 1) + 4 * (b - 1) + c, F.lit(1))).otherwise("X")

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), amino), "")).otherwise("")


def coding_change(ref: Column | str, alt: Column | str) -> Column:
    """frameshift, synonymous, stop_gained, stop_lost or missense, from a coding sequence before and after."""
    before, after = translated(ref), translated(alt)
    stops = lambda x: F.instr(x, "*") > 0
    return (
        F.when((F.length(_c(ref)) - F.length(_c(alt))) % 3 != 0, "frameshift").when(before == after, "synonymous")
        .when(stops(after) & ~stops(before), "stop_gained").when(stops(before) & ~stops(after), "stop_lost").otherwise("missense")
    )


#: Ambiguity codes by their bases in order.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def iupac(bases: Column) -> Column:
    """The code of an array of bases."""
    codes = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, F.array_join(F.array_sort(F.array_distinct(F.transform(bases, F.upper))), "")), F.lit("N"))


def alleles(genotype: Column | str) -> Column:
    """The allele numbers of a genotype such as 0/1:35 or 1|1; a missing one counts as 0."""
    return F.transform(F.split(F.regexp_extract(_c(genotype), "^([^:]*)", 1), "[/|]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def rotated(seq: Column | str, start: Column | int, flip: Column | bool = False) -> Column:
    """A circular sequence begun at a 1-based place, turned over first if flip."""
    s = F.when(F.lit(flip) if isinstance(flip, bool) else flip, reverse_complement(seq)).otherwise(_c(seq))
    at = F.lit(start) if isinstance(start, int) else start
    return F.concat(F.substr(s, at), F.substr(s, F.lit(1), at - 1))


def masked_outside(seq: Column | str, passed: Column) -> Column:
    """Bases at the 1-based places in an array, N elsewhere; the places are walked once, in order."""
    size, text = F.length(_c(seq)), F.split(_c(seq), "")
    places = F.array_sort(F.array_distinct(F.filter(passed, lambda p: (p >= 1) & (p <= size))))

    def put(at: Column) -> Column:
        between = lambda p, k: F.repeat(F.lit("N"), (p - F.coalesce(F.get(at, k - 1), F.lit(0)) - 1).cast("int"))
        kept = F.transform(at, lambda p, k: F.concat(between(p, k), F.get(text, (p - 1).cast("int"))))
        return F.concat(F.array_join(kept, ""), F.repeat(F.lit("N"), (size - F.coalesce(F.array_max(at), F.lit(0))).cast("int")))

    return F.get(F.transform(F.array(places), put), F.lit(0))


def longest_orf(seq: Column | str) -> Column:
    """Codons of the longest stretch without a stop in any of the three frames of the given strand."""
    frames = [F.transform(F.split(translated(F.substr(_c(seq), F.lit(k + 1))), r"\*"), F.length) for k in range(3)]
    return F.array_max(F.concat(*frames))


def gap_pieces(seq: Column | str) -> Column:
    """A scaffold's contigs, apart at runs of N, as (start, piece), 1-based."""
    parts = F.split(F.regexp_replace(_c(seq), "([Nn]+)", "\n$1\n"), "\n")
    walk = F.aggregate(parts, F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,piece:string>>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when((p == "") | p.rlike("^[Nn]"), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), p.alias("piece"))))).alias("out")))
    return walk["out"]


#: Intron motifs (first and last two bases) by their codes in junction tables; any other has code 0.
MOTIFS = {("GT", "AG"): 1, ("CT", "AC"): 2, ("GC", "AG"): 3, ("CT", "GC"): 4, ("AT", "AC"): 5, ("GT", "AT"): 6}


def motif_code(first: Column | str, last: Column | str) -> Column:
    """The code of an intron's motif from its first and last two bases; null where one of them is not of two bases."""
    a, b = F.upper(_c(first)), F.upper(_c(last))
    out = F.when((F.length(a) != 2) | (F.length(b) != 2) | a.isNull() | b.isNull(), F.lit(None).cast("int"))
    for (x, y), code in MOTIFS.items():
        out = out.when((a == x) & (b == y), F.lit(code))
    return out.otherwise(F.lit(0))
