"""Values, units and their comparison as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NR, NUMERIC, UNITS

NUMBER = r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?"
FACTORS = {f"{n}|{u}": x for n, (_, table) in UNITS.items() for u, x in table.items()}
CANONICAL_UNITS = {n: unit for n, (unit, _) in UNITS.items()}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


#: Unicode whitespace.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(v: Column) -> Column:
    """Without Unicode whitespace at the ends (plain trim only knows the space)."""
    return F.btrim(v, F.lit(BLANKS))


def is_nr(v: Column) -> Column:
    """Null, blank or the sentinel in any case."""
    return v.isNull() | F.upper(strip(v)).isin("", NR)


def parse_number(v: Column, nr: Column | None = None) -> Column:
    """The first number of a value; null for abstentions, bounds and ranges.  Here and below nr is is_nr(v), if it is a column already."""
    plain = F.replace(F.replace(F.replace(v, F.lit("−"), F.lit("-")), F.lit("±"), F.lit(" ")), F.lit("+/-"), F.lit(" "))
    found = F.regexp_extract(plain, NUMBER, 0).try_cast("double")
    bound = v.contains("<") | v.contains(">") | v.contains("≤") | v.contains("≥")
    ranged = (v.contains("-") | v.contains("–")) & v.rlike(r"(?U)\d\s*[-–]\s*\d")
    return F.when((is_nr(v) if nr is None else nr) | bound | ranged, F.lit(None).cast("double")).otherwise(found)


def normalise_unit(u: Column, nr: Column | None = None) -> Column:
    return F.when(is_nr(u) if nr is None else nr, F.lit("")).otherwise(F.translate(F.lower(strip(u)), " ·.", ""))


def canonical_amount(x: Column, u: Column, field: Column) -> Column:
    """struct(value, unit) in the field's canonical unit from a number and a normalised unit; both null where that can't be.  A
    loading efficiency without unit is a share if it is at most 1, else a percentage."""
    factor = F.try_element_at(literal_map(FACTORS), F.concat(field, F.lit("|"), u))
    bare = (field == "loading_efficiency") & u.isin("", "fraction")
    amount = F.when(bare, F.when((x >= 0) & (x <= 1), x * 100.0).otherwise(x)).when(u != "", x * factor)
    return F.struct(amount.alias("value"), F.when(amount.isNotNull(), F.try_element_at(literal_map(CANONICAL_UNITS), field)).alias("unit"))


def to_canonical(value: Column, unit: Column, field: Column) -> Column:
    """canonical_amount of a raw value and unit."""
    return canonical_amount(parse_number(value), normalise_unit(unit), field)


def canonical_text(v: Column, nr: Column | None = None) -> Column:
    """Lower-cased with single spaces; abstentions are the sentinel itself."""
    return F.when(is_nr(v) if nr is None else nr, F.lit(NR)).otherwise(F.lower(strip(F.regexp_replace(v, r"(?U)\s+", " "))))


def char_iou(a: Column, b: Column) -> Column:
    """Jaccard index of the two strings' character sets, 0 if either is empty."""
    x, y = F.split(a, ""), F.split(b, "")
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def either_contains(a: Column, b: Column) -> Column:
    """One canonical text inside the other."""
    return a.contains(b) | b.contains(a)


def text_match(a: Column, b: Column) -> Column:
    return either_contains(canonical_text(a), canonical_text(b))


def near(gold: Column, other: Column, tolerance: float) -> Column:
    """Within the tolerance of gold; about zero if gold is."""
    return F.when(F.abs(gold) < 1e-12, F.abs(other) < 1e-12).otherwise(F.abs(gold - other) <= tolerance * F.abs(gold))


def numeric_match(gold_text: Column, other_text: Column, gold_x: Column, other_x: Column, tolerance: float) -> Column:
    """Canonical amounts within tolerance; where either is unknown, equal canonical texts."""
    return F.when(gold_x.isNull() | other_x.isNull(), gold_text == other_text).otherwise(near(gold_x, other_x, tolerance))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _product(x: Column, y: Column) -> tuple[Column, Column]:
    """x * y as a double, and the exact rest (Dekker)."""
    p = x * y
    half = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    xh, yh = half(x), half(y)
    xl, yl = x - xh, y - yh
    return p, ((xh * yh - p) + xh * yl + xl * yh) + xl * yl


def _six_digits(x: Column, shown: Column) -> Column:
    e = F.regexp_extract(shown, r"e([+-]\d+)$", 1).cast("int")
    far = F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")

    def close(k: Column) -> Column:
        """With k decimals."""
        tens = F.element_at(F.array(*[F.lit(10.0**i) for i in range(10)]), k + 1)
        p, rest = _product(F.abs(x), tens)
        n = F.floor(p)
        part = p - n
        up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (n % 2 == 1))))

        def written(m: Column) -> Column:
            decimals = F.regexp_replace(F.lpad((m % tens.cast("long")).cast("string"), k, "0"), "0+$", "")
            digits = F.concat(F.floor(m / tens).cast("string"), F.when((k > 0) & (decimals != ""), F.concat(F.lit("."), decimals)).otherwise(""))
            return F.concat(F.when(x < 0, "-").otherwise(""), F.when((k == 0) & (m >= 1_000_000), "1e+06").otherwise(digits))

        return let(n + up.cast("long"), written)

    return F.when(e.between(-4, 5), let(F.lit(5) - e, close)).otherwise(far)


def number_string(x: Column) -> Column:
    """Whole numbers without a point, others with six significant digits like C's %g: rounded by the exact binary value.  Where the
    engine's own text of the number has no more digits than that, it is the answer already and nothing needs rounding."""
    own = x.cast("string")
    short = ~own.contains("E") & (F.length(F.translate(own, "-.", "")) <= 6)
    toward_zero = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    rounded = let(x, lambda v: let(F.format_string("%.5e", v), lambda shown: _six_digits(v, shown)))
    return F.when(F.abs(x - toward_zero) < 1e-9, toward_zero.cast("string")).when(short, own).otherwise(rounded)


def supported(x: Column, text: Column, evidence: Column, field: Column) -> Column:
    """The number x (or, without one, the canonical text) stands in the canonical evidence; an abstained one supports nothing."""
    numeric = field.isin(NUMERIC) & x.isNotNull()
    return (evidence != NR) & F.when(numeric, evidence.contains(number_string(x))).otherwise(evidence.contains(text))


def answer_in_evidence(value: Column, evidence: Column, field: Column) -> Column:
    return supported(parse_number(value), canonical_text(value), canonical_text(evidence), field)


def value_in_evidence(value: Column, evidence: Column, field: Column) -> Column:
    """Like answer_in_evidence, but a number may also stand there as it was written; abstained values are not supported."""
    raw = canonical_text(evidence).contains(canonical_text(value))
    return ~is_nr(value) & ~is_nr(evidence) & (answer_in_evidence(value, evidence, field) | raw)
