"""Scalar functions as Columns: all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorlode import policy

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(c: Column) -> Column:
    """Upper-cases a-z alone; other scripts keep their letters."""
    return F.translate(c, LOWER, UPPER)


def normalized(c: Column) -> Column:
    """An identifier without U+0020 at its ends, a-z in upper case. Tabs and other spaces stay."""
    return ascii_upper(F.trim(c))


def utf16_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def structure(c: Column) -> Column:
    """Of a normalized identifier: 17 UTF-16 units first, then the alphabet without I, O and Q."""
    return F.when(utf16_length(c) != 17, "UNSUPPORTED_LENGTH").when(c.rlike(r"\A[A-HJ-NPR-Z0-9]{17}\z"), "MODERN_FORMAT").otherwise("INVALID_CHARACTERS")


def type_code_status(hsn: Column, tsn: Column) -> Column:
    """Of normalized codes: which of them has a wrong form."""
    h, t = ~hsn.rlike(r"\A[0-9]{4}\z"), ~tsn.rlike(r"\A[A-Z0-9]{3}\z")
    return F.when(h & t, "INVALID_HSN_AND_TSN").when(h, "INVALID_HSN").when(t, "INVALID_TSN").otherwise("VALID")


def context_problem(year: Column, market: Column) -> Column:
    """Null for a usable context, else what is wrong with it."""
    return F.when(year.isNotNull() & ~year.between(policy.FIRST_YEAR, policy.LAST_YEAR), "INVALID_YEAR").when(market.isNotNull() & ~market.rlike(r"\A[A-Z]{2}\z"), "INVALID_MARKET")


def extended_key(vin: Column) -> Column:
    """First three characters and positions 12 to 14."""
    return F.concat(F.substring(vin, 1, 3), F.substring(vin, 12, 3))


def rich_key(vin: Column) -> Column:
    """Key of the pattern tables: extended if the third character is 9."""
    return F.when(F.substring(vin, 3, 1) == "9", extended_key(vin)).otherwise(F.substring(vin, 1, 3))


def pattern_key(vin: Column) -> Column:
    """What patterns are matched with: positions 4 to 8 and 10 to 17, without the check digit."""
    return F.concat_ws(policy.KEY_SEPARATOR, F.substring(vin, 4, 5), F.substring(vin, 10, 8))


def year_base(vin: Column) -> Column:
    """First year of the cycle that the year code stands for; null if it is none."""
    place = F.instr(F.lit(policy.YEAR_CODES), F.substring(vin, 10, 1))
    return F.when(place > 0, place - 1 + policy.YEAR_BASE)


def year_candidates(vin: Column, year: Column, vehicle_type: Column, truck_type: Column) -> Column:
    """Model years that the code allows: the caller's if it fits, else all cycles up to the horizon,
    narrowed for light vehicles by whether position 7 is a digit."""
    base = year_base(vin)
    end = F.lit(policy.REFERENCE_YEAR + policy.YEAR_HORIZON)
    fits = (year >= policy.YEAR_BASE) & (F.pmod(year - base, F.lit(policy.YEAR_CYCLE)) == 0)
    cycles = F.when(base <= end, F.sequence(base, F.greatest(base, end), F.lit(policy.YEAR_CYCLE))).otherwise(F.array().cast("array<int>"))
    light = vehicle_type.isin(*policy.LIGHT_TYPES) | ((vehicle_type == policy.TRUCK_VEHICLE_TYPE) & (truck_type == policy.LIGHT_TRUCK))
    digit = F.substring(vin, 7, 1).rlike(r"\A[0-9]\z")
    own = F.when(F.coalesce(light, F.lit(False)), F.filter(cycles, lambda y: (y < policy.CYCLE_BEFORE) == digit)).otherwise(cycles)
    none = F.array().cast("array<int>")
    return F.when(base.isNull(), none).when(year.isNotNull(), F.when(fits, F.array(year)).otherwise(none)).otherwise(own)


def captured(key: Column, start: Column, length: Column) -> Column:
    """The digits that a formula pattern captures from a key (start from 0)."""
    return F.substring(key, start + 1, length)


def positional_claim(vin: Column, position: Column, characters: Column) -> Column:
    """Whether a claim holds: unconditional below 0, else the character at the position (from 0) is listed."""
    return (position < 0) | (F.instr(characters, F.substring(vin, position + 1, 1)) > 0)


def mask_matches(vin: Column, mask: Column) -> Column:
    """Whether each character is a dot in the mask or equal."""
    return F.regexp_like(vin, F.concat(F.lit(r"\A"), mask, F.lit(r"\z")))


def full_match(value: Column, pattern: Column) -> Column:
    return F.regexp_like(value, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def identity_key(c: Column) -> Column:
    """Alias key: no white space at the ends, a-z in upper case; null as empty."""
    return ascii_upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", ""))


def text_cell(c: Column) -> Column:
    """A label with single spaces; null if blank or holding control characters."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when((F.length(t) > 0) & ~t.rlike(r"\p{Cntrl}"), t)


def comparable_label(c: Column) -> Column:
    """A label for comparison: upper case, single spaces, punctuation kept."""
    return F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))


def null_cell(c: Column) -> Column:
    """Text of a cell that marks null as backslash N; control characters raise an error."""
    return F.when(c.rlike(r"[\x00-\x1f]"), F.raise_error(F.lit("control character in a cell"))).otherwise(F.coalesce(c, F.lit(r"\N")))


def converted(value: Column, operator: Column, factor: Column) -> Column:
    """value times or over factor, rounded half up to six places, no trailing zeros; null if no number
    (nor one of 26 digits before the point and 12 behind it, or if the result has over 32 before it)."""
    v, f = value.try_cast("decimal(38,12)"), factor.cast("decimal(18,12)")
    text = F.round(F.when(operator == "*", F.try_multiply(v, f)).otherwise(F.try_divide(v, f)), policy.CONVERSION_SCALE).cast("string")
    return F.when(v.isNotNull(), F.regexp_replace(F.when(text.contains("."), F.regexp_replace(text, r"0+\z", "")).otherwise(text), r"\.\z", ""))


def safe_year(c: Column) -> Column:
    """An integer year of a text; null if it is none."""
    return F.when(F.trim(c).rlike(r"\A[+-]?[0-9]+\z"), F.trim(c).try_cast("int"))


def filled(template: str, source: Column, requested: Column) -> Column:
    """A message with {sourceMarket} and {requestedMarket} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{sourceMarket}"), source), F.lit("{requestedMarket}"), F.coalesce(requested, F.lit(policy.UNSPECIFIED_MARKET)))


def directory_identifier(part1: Column, part2: Column) -> Column:
    """A directory row's manufacturer key; null unless its parts agree on whether it is extended."""
    p2 = F.coalesce(part2, F.lit(""))
    good = part1.rlike(r"\A[A-HJ-NPR-Z0-9]{3}\z") & p2.rlike(r"\A(?:[A-HJ-NPR-Z0-9]{3})?\z") & ((F.substring(part1, 3, 1) == "9") == (p2 != ""))
    return F.when(good, F.concat(part1, p2))


def directory_pattern(identifier: Column) -> Column:
    """The whole-identifier rule of a directory key."""
    return F.when(F.length(identifier) == 3, F.concat(identifier, F.lit(".{14}"))).otherwise(F.concat(F.substring(identifier, 1, 3), F.lit(".{8}"), F.substring(identifier, 4, 3), F.lit(".{3}")))


def row_locator(page: Column, row: Column) -> Column:
    return F.format_string("sv31-p%03d-r%03d", page, row)


def templates(c: Column) -> Column:
    """Sorted distinct masks of a template cell; null unless every alternative is well formed."""
    parts = F.transform(F.split(c, " / "), lambda m: F.trim(m))
    fixed = lambda m: F.length(F.replace(m, F.lit("."), F.lit("")))
    good = F.forall(parts, lambda m: m.rlike(r"\A[A-HJ-NPR-Z0-9]{3}[A-HJ-NPR-Z0-9.]{14}\z") & (fixed(m) >= 4))
    return F.when(good, F.array_sort(F.array_distinct(parts)))


def source_date(c: Column) -> Column:
    """A date as ISO or day.month.year; null otherwise."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd.MM.yyyy"))


def urls(c: Column) -> Column:
    """Addresses in a text, without punctuation that ends them."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:]+\z", ""))


def decoded_cell(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def encoded_cell(c: Column) -> Column:
    return F.base64(c.cast("binary"))
