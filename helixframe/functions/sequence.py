"""Column functions over DNA strings: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code (NCBI table 1), bases in the order T, C, A, G.
CODON_BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Complements of the IUPAC nucleotide letters.
IUPAC, IUPAC_COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(col(s), IUPAC, IUPAC_COMPLEMENT))


def canonical(s) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(col(s), reverse_complement(s))


def kmers(s, k: int) -> Column:
    """All k-letter words in order; empty if the sequence is shorter."""
    s = col(s)
    last = F.length(s) - k + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: s.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def valid_alphabet(s, letters: str = "ACGT") -> Column:
    return F.coalesce(col(s).rlike(f"^[{letters}]+$"), F.lit(False))


def gc_fraction(s, places: int = 12) -> Column:
    s = col(s)
    return F.round(F.try_divide(F.length(F.regexp_replace(s, "[^GCgc]", "")), F.length(s)), places)


def masked_bases(s) -> Column:
    return F.length(F.regexp_replace(col(s), "[^a-z]", ""))


def ambiguous_bases(s) -> Column:
    return F.length(F.regexp_replace(F.upper(col(s)), "[ACGT]", ""))


def clean(s) -> Column:
    """Upper case, without digits and white space."""
    return F.upper(F.regexp_replace(col(s), r"[\s0-9]", ""))


def hamming(a, b) -> Column:
    """Differing places of equally long strings; null if lengths differ."""
    a, b = col(a), col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda t, x: t + x))


def one_hot(s, letters: str = "ACGT") -> Column:
    """Array of arrays, 1.0 at the letter's place, zeros for other letters."""
    return F.transform(F.split(col(s), ""), lambda x: F.array(*[(x == c).cast("double") for c in letters]))


def window_around(s, at, radius: int, pad: str = "N") -> Column:
    """2 * radius + 1 letters around a place from 0, padded at both ends."""
    s, at = col(s), col(at)
    padded = F.concat(F.lit(pad * radius), s, F.lit(pad * radius))
    return padded.substr(at + 1, F.lit(2 * radius + 1))


def codon_map() -> Column:
    pairs = [(a + b + c, AMINO_ACIDS[16 * i + 4 * j + k]) for i, a in enumerate(CODON_BASES) for j, b in enumerate(CODON_BASES) for k, c in enumerate(CODON_BASES)]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def translate_frame(s) -> Column:
    """Amino acids of the first frame up to the first stop (excluded); unknown
    codons give X."""
    s = col(s)
    n = F.floor(F.length(s) / 3).cast("int")
    table = codon_map()
    acids = F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.coalesce(F.try_element_at(table, s.substr(i * 3 + 1, F.lit(3))), F.lit("X")))).otherwise(F.array().cast("array<string>"))
    return F.substring_index(F.array_join(acids, ""), "*", 1)


def common_prefix(a, b) -> Column:
    """Letters that both strings begin with alike."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))


def edit_span(ref, alt) -> Column:
    """struct(start, end, ref, alt): the common prefix goes, then the suffix;
    start and end are places of the reference from 0, end excluded."""
    ref, alt = col(ref), col(alt)
    p = common_prefix(ref, alt)
    r, a = ref.substr(p + 1, F.length(ref)), alt.substr(p + 1, F.length(alt))
    s = common_prefix(F.reverse(r), F.reverse(a))
    return F.struct(p.alias("start"), (F.length(ref) - s).alias("end"), r.substr(F.lit(1), F.length(r) - s).alias("ref"), a.substr(F.lit(1), F.length(a) - s).alias("alt"))


def edit_kind(ref, alt, circuit: bool = False) -> Column:
    """snv, mnv, insertion, deletion, delins; the circuit vocabulary has
    identical, and calls length changes insertion or deletion by sign."""
    r, a = F.length(col(ref)), F.length(col(alt))
    if circuit:
        return F.when(col(ref) == col(alt), "identical").when(r > a, "deletion").when(r < a, "insertion").when(r == 1, "snv").otherwise("mnv")
    return F.when((r == 1) & (a == 1), "snv").when(r == 0, "insertion").when(a == 0, "deletion").when(r == a, "mnv").otherwise("delins")


def apply_edit(s, start, end, ref, alt) -> Column:
    """The sequence with [start, end) replaced; null if it isn't ref there."""
    s, start, end = col(s), col(start), col(end)
    return F.when(s.substr(start + 1, end - start) == col(ref), F.concat(s.substr(F.lit(1), start), col(alt), s.substr(end + 1, F.length(s))))


def revert_edit(s, start, ref, alt) -> Column:
    return apply_edit(s, start, col(start) + F.length(col(alt)), alt, ref)


def parse_edit(token) -> Column:
    """POS:REF>ALT with POS from 1 -> struct(start, end, ref, alt) from 0."""
    part = lambda k: F.regexp_extract(col(token), r"^([1-9]\d*):([ACGT]*)>([ACGT]*)$", k)
    start = F.try_to_number(part(1), F.lit("99999999999")).cast("long") - 1
    return F.when(part(1) != "", F.struct(start.alias("start"), (start + F.length(part(2))).alias("end"), part(2).alias("ref"), part(3).alias("alt")))


def coding_effect(before, after) -> Column:
    """Effect of a coding change, from the coding strings before and after."""
    b, a = col(before), col(after)
    pb, pa = translate_frame(b), translate_frame(a)
    shift = (F.abs(F.length(a) - F.length(b)) % 3) != 0
    return F.when(a == b, "identical").when(pa.substr(1, 1) != pb.substr(1, 1), "start_loss").when(shift, "frameshift").when(pa == pb, "synonymous").when(F.length(pa) < F.length(pb), "nonsense").otherwise("missense")
