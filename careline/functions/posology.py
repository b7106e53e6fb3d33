"""Days covered by one dose, from the coded prescription frequency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.rounding import round_to

# Fixed values: (frequency type, field tested, pattern, rule). The first line
# that applies decides. Rules: a number is a constant; "lead" takes the leading
# digits of the code, "lead1" its first digit, "digits"/"desc_lead" the digits of
# the description; then the arithmetic.
RULES = (
    (None, "code", r"MES", ("lead1", "times", 30.0, None)),
    ("4", "code", r"^SET", 7.0),
    ("4", "code", r"\d+SET", ("lead", "times", 7.0, None)),
    ("4", "code", r"D[MT]|\d+D", ("lead", "times", 1.0, None)),
    ("4", "code", r"^\d+[MTN]", ("lead", "over", 24.0, None)),
    ("4", "code", r"^\d+$", ("lead", "times", 1.0, None)),
    ("7", None, None, 1.0),
    ("5", "desc", r"^c/\d+h", ("digits", "over", 24.0, 2)),
    ("5", "code", r"^LU|^MA|^MI|^JU|^VI|^SA|^DO|^SET", 7.0),
    ("5", "code", r"^A\d+|^[EDNS]S?$|^E$", 1.0),
    ("5", "code", r"EDS", 0.3),
    ("5", "code", r"\d+-\d+", 0.5),
    ("5", "code", r"^\d+SET", ("desc_lead", "into", 7.0, 1)),
    ("6", "code", r"\d+", ("digits", "into", 24.0, 1)),
    ("0", "code", r"1 DOSIS", 1.0),
)
EXTRACTS = {
    "lead1": ("code", r"^\d"),
    "lead": ("code", r"^\d+"),
    "digits": ("desc", r"\d+"),
    "desc_lead": ("desc", r"^\d+"),
}


def posology_days(freq_type: Column, freq_code: Column, freq_desc: Column) -> Column:
    fields = {"code": freq_code, "desc": freq_desc}

    def value(rule) -> Column:
        if isinstance(rule, float):
            return F.lit(rule)
        extract, operation, constant, digits = rule
        field, pattern = EXTRACTS[extract]
        number = F.regexp_extract(fields[field], pattern, 0).try_cast("double")
        if operation == "times":
            result = number * F.lit(constant)
        elif operation == "over":
            result = number / F.lit(constant)
        else:
            # a zero frequency divides to infinity
            result = F.when(number == 0, F.lit(float("inf"))).otherwise(
                F.try_divide(F.lit(constant), number))
        return result if digits is None else round_to(result, digits)

    decision = None
    for kind, field, pattern, rule in RULES:
        applies = F.lit(True) if kind is None else freq_type == kind
        if field is not None:
            applies = applies & F.coalesce(fields[field].rlike(pattern), F.lit(False))
        decision = (F.when(applies, value(rule)) if decision is None
                    else decision.when(applies, value(rule)))
    return decision
