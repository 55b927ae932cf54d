"""Column expressions over nucleotide and colour strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base alphabet in the order of its codes, its complement, and the ambiguity letters that become N.
ALPHABET, COMPLEMENT = "ACGT", "TGCA"
AMBIGUOUS = "RYMKWSBDHV"


def complement(c: Column) -> Column:
    return F.translate(c, ALPHABET + ALPHABET.lower(), COMPLEMENT + COMPLEMENT.lower())


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def normalised(c: Column) -> Column:
    """U to T and ambiguity letters to N, keeping case."""
    low = AMBIGUOUS.lower()
    return F.translate(c, "Uu" + AMBIGUOUS + low, "Tt" + "N" * len(AMBIGUOUS) + "n" * len(low))


def is_sequence(c: Column) -> Column:
    """Only bases, N and '.'."""
    return c.rlike(r"^[ACGTNacgtn.]*$")


def base_code(c: Column) -> Column:
    """0 to 3 for A, C, G, T of either case; 4 for anything else."""
    place = F.instr(F.lit(ALPHABET), F.upper(c))
    return F.when((place > 0) & (F.length(c) == 1), place - 1).otherwise(4).cast("int")


def is_repeat(c: Column) -> Column:
    """Whether any base is lower case, which marks repeats."""
    return c.rlike("[acgtn]")


def code_base(c: Column) -> Column:
    return F.when(c.between(0, 3), F.substring(F.lit(ALPHABET), c.cast("int") + 1, F.lit(1))).otherwise("N")


def _codes(seq: Column) -> Column:
    return F.transform(F.split(F.translate(F.upper(seq), ALPHABET, "0123"), ""), lambda b: F.when(b.isin("0", "1", "2", "3"), b.cast("int")).otherwise(4))


def colors(seq: Column, start: str = "A") -> Column:
    """The colour between each base and the one before it (``start`` before the first): exclusive or of codes, 4 if either is no base."""
    codes = _codes(seq)
    before = F.slice(F.concat(F.array(F.lit(ALPHABET.index(start))), codes), 1, F.length(seq))
    paired = F.zip_with(before, codes, lambda a, b: F.when((a == 4) | (b == 4), 4).otherwise(a.bitwiseXOR(b)))
    return F.when(seq == "", "").otherwise(F.array_join(paired.cast("array<string>"), ""))


def bases_of_colors(color: Column, start: str = "A") -> Column:
    """The bases that colours lead to from ``start``; an unknown colour gives N and keeps the base before it."""
    step = F.split(F.translate(color, ".", "4"), "")
    zero = F.struct(F.lit(ALPHABET.index(start)).alias("last"), F.lit("").alias("out"))

    def follow(acc: Column, c: Column) -> Column:
        known = c.isin("0", "1", "2", "3")
        now = F.when(known, acc["last"].bitwiseXOR(F.when(known, c).otherwise("0").cast("int"))).otherwise(acc["last"])
        return F.struct(now.alias("last"), F.concat(acc["out"], F.when(known, code_base(now)).otherwise("N")).alias("out"))

    return F.when(color == "", "").otherwise(F.aggregate(step, zero, follow, lambda acc: acc["out"]))


def normalised_color_read(read: Column, start: str = "A") -> Column:
    """A colour read that begins with another adaptor base, as one that begins with ``start``."""
    adaptor, first = base_code(F.substring(read, 1, 1)), F.substring(read, 2, 1)
    known = first.isin("0", "1", "2", "3") & (adaptor < 4)
    code = F.when(known, first).otherwise("0").cast("int").bitwiseXOR(F.when(adaptor < 4, adaptor).otherwise(0)).bitwiseXOR(F.lit(ALPHABET.index(start)))
    return F.concat(F.lit(start), F.when(known, code.cast("string")).otherwise("4"), F.substring(read, F.lit(3), F.length(read)))


def cleaned_read(read: Column) -> Column:
    """White space removed, '.' as N, upper case."""
    return F.upper(F.translate(F.regexp_replace(read, r"\s", ""), ".", "N"))


#: Places of a read whose cover is told together, as bits of a number.
WORD = 32


def mask_of(offsets: Column, length: Column, mask: str, strand: Column) -> Column:
    """Which places of a read its seeds cover, as 0 and 1 in read order; on the reverse strand the mask is turned round.

    The mask is a number, a bit a place, which is shifted to each offset: once for each ``WORD`` places that it may touch. Wider masks than a number go place by place.
    """
    if len(mask) > 62:
        return _mask_by_places(offsets, length, mask, strand)
    bits = lambda m: F.lit(sum(1 << i for i, c in enumerate(m) if c == "1")).cast("long")
    own = F.when(strand == "-", bits(mask[::-1])).otherwise(bits(mask))
    shift = lambda way, c, n: F.call_function(f"shift{way}", c, n)
    one, every = F.lit(1).cast("long"), F.lit((1 << WORD) - 1).cast("long")

    def word(k: Column) -> Column:
        def joined(acc: Column, offset: Column) -> Column:
            by = (offset - k * WORD).cast("int")
            ahead = shift("left", own.bitwiseAND(shift("left", one, F.lit(WORD) - by) - 1), by)
            behind = shift("rightunsigned", own, -by).bitwiseAND(every)
            return acc.bitwiseOR(F.when(by.between(0, WORD - 1), ahead).when(by.between(1 - len(mask), -1), behind).otherwise(F.lit(0).cast("long")))

        return F.reverse(F.lpad(F.bin(F.aggregate(offsets, F.lit(0).cast("long"), joined)), WORD, "0"))

    words = F.transform(F.sequence(F.lit(0), ((length - 1) / WORD).cast("int")), word)
    return F.when(length > 0, F.substring(F.array_join(words, ""), F.lit(1), length)).otherwise("")


def _mask_by_places(offsets: Column, length: Column, mask: str, strand: Column) -> Column:
    forward, backward = F.lit(mask), F.lit(mask[::-1])
    own = F.when(strand == "-", backward).otherwise(forward)

    def covered(p: Column) -> Column:
        return F.exists(offsets, lambda o: (p >= o) & (p < o + len(mask)) & (F.substring(own, (p - o + 1).cast("int"), F.lit(1)) == "1"))

    bits = F.transform(F.sequence(F.lit(0), length - 1), lambda p: F.when(covered(p), "1").otherwise("0"))
    return F.when(length > 0, F.array_join(bits, "")).otherwise("")


def mask_to_bits(mask: Column) -> Column:
    """A string of up to 64 of 0 and 1, the first place lowest, as a number."""
    return F.conv(F.reverse(mask), 2, 10).cast("long")


def bits_to_mask(bits: Column, length: Column) -> Column:
    return F.reverse(F.lpad(F.bin(bits), length, "0"))


def add_log10(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b)."""
    high, low = F.greatest(a, b), F.least(a, b)
    return high + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), low - high))


def within(contig: Column, position: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Whether a place lies in the inclusive range from (contig, position) to (contig, position)."""
    here = F.struct(contig.cast("long"), position.cast("long"))
    at = lambda p: F.struct(F.lit(p[0]).cast("long"), F.lit(p[1]).cast("long"))
    return (here >= at(start)) & (here <= at(end))


def expected_random_hits(read_length: Column, key_size: int, genome: Column, alphabet: int = 4) -> Column:
    """Hits that the keys of a random read have by chance: (L - k + 1) * G / A**k."""
    return (read_length - key_size + 1) * genome / F.lit(float(alphabet) ** key_size)


def index_bytes(genome: Column, contigs: Column, hash_width: int) -> Column:
    """Size of an index: a place takes 5 bytes with up to 256 contigs, else 8; the prefix table 4 for each of its 4**j entries."""
    return F.when(contigs <= 256, 5).otherwise(8) * genome + 4 * 4**hash_width


def number_list(text: str) -> list[int]:
    """``1,5-6,10`` as numbers."""
    out: list[int] = []
    for part in filter(None, text.split(",")):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return out
