"""Sequences, barcodes and identities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer codes of bases and padding, in order.
BASES = ("A", "C", "G", "T", "N", "PAD")


def encode(sequence: Column) -> Column:
    """Base codes; unknown letters are N."""
    return _digits(F.translate(_letters(sequence), "ACGTN", "01234"), "tinyint")


def _letters(sequence: Column) -> Column:
    """Upper case, with N for what is none of A C G T N."""
    return F.regexp_replace(F.upper(sequence), r"(?s)[^ACGTN]", "N")


def _digits(text: Column, kind: str) -> Column:
    """Digits as numbers, by casts of the whole array, which are compiled where functions of an element are not; an empty text has none."""
    return F.array_remove(F.split(text, ""), "").cast(f"array<{kind}>")


def decode(codes: Column) -> Column:
    """Letters of base codes, padding as N; a code that is none is an error."""
    bad = (F.array_max(codes) > 5) | (F.array_min(codes) < 0)
    return F.when(bad, F.raise_error(F.lit("a base code is from 0 to 5"))).otherwise(F.translate(F.array_join(codes.cast("array<string>"), ""), "012345", "ACGTNN"))


def phred_string(scores: Column) -> Column:
    """Phred+33 text, scores clipped to the printable range."""
    return F.array_join(F.transform(scores, lambda q: F.char(F.least(F.greatest(q, F.lit(0)), F.lit(93)) + 33)), "")


def complement(sequence: Column) -> Column:
    return F.translate(sequence, "ACGTNacgtn", "TGCANtgcan")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def one_hot(sequence: Column) -> Column:
    """Five flags a base, in the order A C G T N."""
    text = _letters(sequence)
    for k, letter in enumerate(BASES[:5]):
        text = F.replace(text, F.lit(letter), F.lit("0" * k + "1" + "0" * (4 - k)))
    return _digits(text, "int")


def one_hot_decode(flags: Column) -> Column:
    """The letter of the first flag that is set of each five, A where none is."""
    # A comma after each five keeps replacements from starting inside one; patterns are for fives with no flag or several, and digits that are no five go last.
    # One chain, each step of which is used once, since the steps would be computed for each use.
    text = F.regexp_replace(F.array_join(flags.cast("array<string>"), "", "0"), "(.{5})", "$1,")
    for k, letter in enumerate(BASES[:5]):
        text = F.replace(text, F.lit("0" * k + "1" + "0" * (4 - k) + ","), F.lit(letter))
    for k, letter in enumerate(BASES[:5]):
        text = F.regexp_replace(text, "[^,]{%d}1[^,]{%d}," % (k, 4 - k), letter)
    return F.translate(F.regexp_replace(text, "[^,]{5},", "A"), "0123456789", "")


def _counts(sequence: Column, letters: str = "ACGT") -> list[Column]:
    return [(F.length(sequence) - F.length(F.replace(sequence, F.lit(c)))).cast("double") for c in letters]


def entropy(sequence: Column) -> Column:
    """Shannon entropy in bits of the composition over A C G T."""
    n = _counts(sequence)
    total = reduce(lambda a, b: a + b, n)
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in n]
    return F.when(total > 0, reduce(lambda a, b: a + b, terms)).otherwise(0.0)


def homopolymer_fraction(sequence: Column) -> Column:
    return F.when(F.length(sequence) > 0, F.greatest(*_counts(sequence, "ACGTN")) / F.length(sequence)).otherwise(0.0)


def unique_bases(sequence: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(sequence, ""), lambda c: c != "")))


def umi_failure(umi: Column, length: int, *, max_fraction: float = 0.7, min_unique: int = 2, max_run: int = 4) -> Column:
    """The first reason why a barcode fails, or null."""
    return (
        F.when(umi.isNull(), "missing").when(umi == "", "empty").when(F.length(umi) != length, F.concat(F.lit("wrong_length_"), F.length(umi).cast("string"))).when(F.contains(umi, F.lit("N")), "contains_N")
        .when(homopolymer_fraction(umi) > max_fraction, "high_homopolymer_fraction").when(unique_bases(umi) < min_unique, "low_complexity").when(umi.rlike("(.)\\1{%d,}" % max_run), f"homopolymer_run_gt{max_run}")
    )


def molecule_uid(experiment: Column, template: Column) -> Column:
    """32 hex digits of the digest of both parts, each with its length before it."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.substring(F.sha2(F.concat(part(experiment), part(template)).cast("binary"), 256), 1, 32)


def segment_uid(experiment: Column, template: Column, segment: Column) -> Column:
    return molecule_uid(molecule_uid(experiment, template), segment)


def _url64(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/", "-_"), F.lit("="))


def pooled_name(experiment: Column, read: Column) -> Column:
    return F.concat(F.lit("m1."), _url64(experiment), F.lit("."), _url64(read))


def split_pooled_name(name: Column) -> Column:
    """struct<experiment, read>"""
    part = lambda k: F.unbase64(F.rpad(F.translate(F.split_part(name, F.lit("."), F.lit(k)), "-_", "+/"), (F.ceil(F.length(F.split_part(name, F.lit("."), F.lit(k))) / 4) * 4).cast("int"), F.lit("="))).cast("string")
    return F.struct(part(2).alias("experiment"), part(3).alias("read"))


def bucket(uid: Column) -> Column:
    return F.concat(F.lit("b"), F.substring(uid, 1, 2))


def reference_uid(sequence: Column) -> Column:
    return F.sha2(F.concat(F.upper(sequence), F.lit("|"), F.length(sequence).cast("string")).cast("binary"), 256)


def end_status(front: Column, rear: Column, threshold: float) -> Column:
    """struct<status, confidence> of a read by its two end scores."""
    a, b = front >= threshold, rear >= threshold
    status = F.when(a & b, "double").when(a | b, "single").otherwise("unclassified")
    decisive = F.when(a & b, F.least(front, rear)).otherwise(F.greatest(front, rear))
    distance = F.when(decisive >= threshold, (decisive - threshold) / (100 - threshold)).otherwise((threshold - decisive) / threshold)
    return F.struct(status.alias("status"), F.when(front.isNull() | rear.isNull(), 0.0).otherwise(F.least(F.greatest(distance, F.lit(0.0)), F.lit(1.0))).alias("confidence"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


#: Source base and converted base by chemistry and strand.
CONVERSIONS = {("conversion", "top"): ("C", "T"), ("conversion", "bottom"): ("G", "A"), ("deaminase_A", "top"): ("A", "G"), ("deaminase_A", "bottom"): ("T", "C")}


def conversion_call(reference: Column, observed: Column, chemistry: str, strand: str, converted_is: int = 0) -> Column:
    """1 for a modified (kept) base, 0 for a converted one, null elsewhere; footprinting chemistries set converted_is to 1."""
    source, made = CONVERSIONS[(chemistry, strand)]
    return F.when((reference == source) & (observed == made), converted_is).when((reference == source) & (observed == source), 1 - converted_is)


def fuzzy_find(seq: Column, flank: str, most: int) -> Column:
    """(distance, start, length) of the nearest place of a flank, by edits, leftmost and shortest first; null where more than `most` edits are needed.

    A window of other lengths than the flank's by up to `most` holds every place within `most` edits.
    """
    sizes = [len(flank) + k for k in range(-most, most + 1) if len(flank) + k > 0]

    def places(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - n, F.lit(0)))
        found = F.transform(starts, lambda i: F.struct(F.levenshtein(F.substring(seq, i + 1, F.lit(n)), F.lit(flank)).alias("distance"), i.alias("start"), F.lit(n).alias("length")))
        return F.filter(found, lambda x: x["start"] + n <= F.length(seq))

    best = F.array_min(F.concat(*map(places, sizes)))
    return F.when(best["distance"] <= most, best)
