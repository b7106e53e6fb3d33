"""Delimited extracts: `;` between fields, decimal comma, one header line.

Everything is read as text in one pass (no inference scan) and typed afterwards:
first by column-name pattern, then by the canonical schema of the table.
"""

from __future__ import annotations

import re
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careline.functions.text import drop_last_character, integer_of
from careline.operators.dispensing import valid_ids, with_posology

_ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?)?\s*$"
_SECOND = r"(\d{2}(?:\.\d+)?)"
# Layouts of a date and time, tried in order; each covers the whole text. A time without seconds and a
# date without time fit none, and of texts without separators only those with a year of four digits do.
DATE_TIMES = (
    # separators between all parts, a year of four digits or of two
    r"^\s*(\d{4}|\d{2})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{1,2})(?:[^0-9A-Za-z]+|[Tt])"
    r"(\d{1,2})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{1,2}(?:\.\d+)?)" + _ZONE,
    # no separators but, perhaps, one between date and time
    r"^\s*(\d{4})(\d{2})(\d{2})(?:[Tt]|[^0-9A-Za-z]+)?(\d{2})(\d{2})" + _SECOND + _ZONE,
    # a date with separators, a time without
    r"^\s*(\d{4})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{1,2})(?:[^0-9A-Za-z]+|[Tt])"
    r"(\d{2})(\d{2})" + _SECOND + _ZONE,
    # a date without separators, a time with
    r"^\s*(\d{4})(\d{2})(\d{2})(?:[^0-9A-Za-z]+|[Tt])"
    r"(\d{1,2})[^0-9A-Za-z]+(\d{1,2})[^0-9A-Za-z]+(\d{1,2}(?:\.\d+)?)" + _ZONE,
)

# Times as they mostly stand, which take one look each: what the engine reads as it is, and 14 digits.
PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?\z"
DIGITS_TIME = r"^\d{14}\z"

# Source column, canonical column and type of the three extracts.
STEP_COLUMNS = (
    ("NHC", "nhc_raw", "text"), ("NHC..sense.ceros.", "nhc", "text"), ("CIP", "cip", "text"),
    ("Procés.ID", "process_id", "bigint"),
    ("RPT.ATC.Codi", "drug_code", "text"), ("RPT.ATC.Descripció", "drug_name", "text"),
    ("RPT.Indicació.Codi", "indication_code", "text"),
    ("RPT.Indicació.Descripció", "indication_name", "text"),
    ("Procés.Inici.Data", "process_start", "time"), ("Procés.Fi.Data", "process_end", "time"),
    ("Pas.Codi", "step_code", "text"), ("Pas.Alliberat.Data", "step_ts", "time"),
    ("Pas.Número.dins.el.procés", "step_no", "int"),
    ("Pas.següent.data", "next_step_ts", "time"), ("Pas.previ.data", "prev_step_ts", "time"),
    ("Variable.Descripció.Llarga", "variable_name", "text"),
    ("Valor.Variable.Codi", "score", "number"),
    ("Sexe", "sex", "text"), ("Data.naixement", "birth_date", "time"),
)
DISPENSING_COLUMNS = (
    ("Nhc", "nhc_raw", "text"), ("Cip", "cip", "text"), ("Medicament.Codi", "med_code", "text"),
    ("Medicament.Descripció", "med_name", "text"), ("Medicament.AGRUPAT", "med_group", "text"),
    ("Episodi", "episode", "text"), ("Especialitat..Codi.nacional.", "national_code", "int"),
    ("Especialitat.Descripció", "specialty_name", "text"),
    ("Forma.Medicament.Descripció", "form_name", "text"),
    ("Data.Consum", "dispensed_at", "time"), ("Quantitat.Ecofin", "qty", "number"),
)
PRESCRIPTION_COLUMNS = (
    ("Centre Codi", "center_code", "text"), ("NHC (sense ceros)", "nhc", "text"),
    ("NHC", "presc_nhc_raw", "text"), ("CIP", "presc_cip", "text"),
    ("Prescripció ID", "prescription_id", "text"),
    ("Prescripció ID Inicial", "initial_prescription_id", "text"),
    ("Medicament Codi", "med_code", "text"), ("Medicament Descripció", "med_name", "text"),
    ("Especialitat Codi Nacional", "presc_national_code", "text"),
    ("Especialitat Descripció", "presc_specialty_name", "text"),
    ("Dosi Prescrita", "dose", "number"), ("Freqüència Tipus Codi", "freq_type", "text"),
    ("Freqüència Codi", "freq_code", "text"), ("Freqüència Descripció", "freq_desc", "text"),
    ("Data Inici Prescripció", "valid_from", "time"), ("Data Fi Prescripció", "valid_to", "time"),
)


def mangled(names: list[str]) -> list[str]:
    """Header names with every character outside letters, digits and `_` as a dot.

    A name that doesn't begin with a letter, or a dot without a digit behind it, gets an `X` before it.
    """
    seen: dict[str, int] = {}
    result = []
    for name in names:
        clean = re.sub(r"[^\w.]", ".", name)
        if not re.match(r"[^\W\d_]|\.(?!\d)", clean):
            clean = f"X{clean}"
        seen[clean] = seen.get(clean, -1) + 1
        result.append(clean if seen[clean] == 0 else f"{clean}.{seen[clean]}")
    return result


MISSING = "NA"


#: Header lines that are read at once.
HEADER_READERS = 8


def _headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The files of a folder by their header line; a line for each file on the driver.

    The listing opens no file, and of a file only its beginning is read, so what the scan costs to plan
    goes by the number of files and not by their size.
    """
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
              .select("path", "length").filter("length > 0"))
    paths = sorted(r.path for r in listed.collect())

    def first(path: str) -> str | None:
        line = spark.read.text(path).head(1)
        return line[0].value if line else None
    files: dict[str, list[str]] = {}
    with ThreadPool(HEADER_READERS) as pool:
        for path, header in zip(paths, pool.map(first, paths), strict=True):
            if header is not None:
                files.setdefault(header, []).append(path)
    return files


def read_delimited(spark: SparkSession, folder: str, mangle_header: bool = True) -> DataFrame:
    """All `.csv` files of a folder as text columns; empty fields and `NA` are NULL.

    Columns go by name: files may have them in another order, and lack some.
    """
    whole = None
    for paths in _headers(spark, folder).values():
        rows = (spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8")
                .option("quote", '"').option("escape", '"').option("nullValue", MISSING)
                .option("emptyValue", MISSING).option("enforceSchema", False).csv(paths))
        rows = rows.toDF(*mangled(rows.columns)) if mangle_header else rows
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    if whole is None:
        raise FileNotFoundError(f"no .csv file with a header in {folder}")
    return whole


def to_number(text: Column) -> Column:
    """Number with decimal comma (or point); anything else is NULL."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def _in_layout(text: Column, layout: str) -> Column:
    """Timestamp of a text in one layout; a zone behind it counts, without one it is UTC."""
    year, zone = F.regexp_extract(text, layout, 1), F.regexp_extract(text, layout, 7)
    short = year.try_cast("int")
    year = (F.when(F.length(year) == 4, year)
             .otherwise((short + F.when(short <= 68, 2000).otherwise(1900)).cast("string")))
    # +02 and +0200 are +02:00
    zone = F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(F.endswith(zone, F.lit(":")), F.concat(zone, F.lit("00"))).otherwise(zone)
    return F.try_to_timestamp(F.concat(
        year, F.regexp_replace(text, layout, "-$2-$3 $4:$5:$6"), zone))


def to_time(text: Column) -> Column:
    """Timestamp from date and time text in one of DATE_TIMES; NULL if it is in none.

    Years 00-68 are 2000-2068, 69-99 1969-1999. A date or time that doesn't exist is NULL.
    """
    def digits(at: int, n: int) -> Column:
        return F.substring(text, at, n)

    spaced = F.concat(F.concat_ws("-", digits(1, 4), digits(5, 2), digits(7, 2)), F.lit(" "),
                      F.concat_ws(":", digits(9, 2), digits(11, 2), digits(13, 2)))
    found = (F.when(text.rlike(PLAIN_TIME), F.try_to_timestamp(text))
             .when(text.rlike(DIGITS_TIME), F.try_to_timestamp(spaced)))
    for layout in DATE_TIMES:
        found = found.when(text.rlike(layout), _in_layout(text, layout))
    return found


def typed_projection(frame: DataFrame) -> DataFrame:
    """Type text columns by name: `data` anywhere, leading `Valor.Variable` or `nhc`."""
    def typed(name: str) -> Column:
        c = F.col(f"`{name}`")
        if "data" in name.lower():
            c = to_time(c)
        elif name.lower().startswith("valor.variable"):
            c = to_number(c)
        elif name.lower().startswith("nhc"):
            c = c.cast("string")
        return c.alias(name)

    return frame.select(*[typed(n) for n in frame.columns])


def canonical(frame: DataFrame, columns) -> DataFrame:
    """Rename and type the columns of an extract; columns it lacks are left out."""
    types = dict(frame.dtypes)

    def typed(source: str, kind: str) -> Column:
        c = F.col(f"`{source}`")
        if types[source] != "string":
            return c
        return {"text": lambda: c, "time": lambda: to_time(c), "number": lambda: to_number(c),
                "int": lambda: integer_of(c),
                "bigint": lambda: c.try_cast("bigint")}[kind]()

    return frame.select(*[typed(source, kind).alias(name)
                          for source, name, kind in columns if source in types])


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    return canonical(typed_projection(read_delimited(spark, folder)), STEP_COLUMNS)


def read_dispensings(spark: SparkSession, folder: str) -> DataFrame:
    rows = typed_projection(read_delimited(spark, folder))
    return valid_ids(canonical(rows, DISPENSING_COLUMNS), "nhc_raw")


def read_prescriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Prescriptions with their posology; the national code loses its check digit."""
    rows = typed_projection(read_delimited(spark, folder, mangle_header=False))
    code = integer_of(drop_last_character(F.col("presc_national_code")))
    return with_posology(valid_ids(canonical(rows, PRESCRIPTION_COLUMNS), "presc_nhc_raw")
                         .withColumn("presc_national_code", code))

