"""SQL that computes every registered query from the same tables.

Written for checking: windows and joins over whole tables, in the order the
analysis is defined, not in the order the Spark operators evaluate it.
"""

from __future__ import annotations

from careline.plans.registry import DOSE_DRUG, EXCLUDED_DRUG, TIMELINE_YEAR, fingerprint
from careline.sources import star

Y = star.AS_OF_YEAR
AS_OF = f"TIMESTAMP '{star.AS_OF} 00:00:00'"


# Expressions ------------------------------------------------------------------

def days(a: str, b: str, unit: float = 86_400_000_000.0) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / {unit}) AS BIGINT)"


def whole_months(a: str, b: str) -> str:
    return f"CAST(datesub('month', {a}, {b}) AS INT)"


def months(a: str, b: str) -> str:
    """Months with fraction for a <= b."""
    k = f"CAST(datesub('month', {a}, {b}) AS INT)"
    low, high = f"epoch_us({a} + to_months({k}))", f"epoch_us({a} + to_months({k} + 1))"
    return f"({k} + (epoch_us({b}) - {low}) / CAST({high} - {low} AS DOUBLE))"


def rnd(x: str, digits: int) -> str:
    p = float(10 ** digits)
    return f"(sign({x}) * floor(abs({x}) * {p} + 0.5) / {p})"


def pct_text(x: str) -> str:
    return f"coalesce(regexp_replace(CAST({x} AS VARCHAR), '\\.0$', ''), 'NA') || '%'"


def band(x: str, capped: bool = True) -> str:
    cut = f"{x} > 5.1 AND {x} <= 10" if capped else f"{x} > 5.1"
    return (f"CASE WHEN {x} < 2.6 THEN 'Remissió' WHEN {x} <= 3.2 THEN 'Activitat baixa' "
            f"WHEN {x} <= 5.1 THEN 'Activitat moderada' WHEN {cut} THEN 'Activitat alta' END")


def t_tail(t: str, df: str, terms: int = 4000) -> str:
    """Two-sided Student tail as a power series of the incomplete beta function."""
    x = f"({df} / ({df} + {t} * {t}))"
    return (f"(SELECT sum(exp(({df} / 2.0 + i) * ln({x}) + 0.5 * ln(1 - {x}) + lgamma({df} / 2.0 + 0.5 + i)"
            f" - lgamma(0.5) - lgamma({df} / 2.0 + i + 1))) FROM range({terms}) g(i))")


def chisq_tail(x: str, df: str, terms: int = 4000) -> str:
    """Upper chi-square tail: one minus the series of the lower incomplete gamma."""
    return (f"(SELECT CASE WHEN {x} > 1400 THEN 0.0 ELSE 1 - sum(exp(({df} / 2.0 + i) * ln({x} / 2)"
            f" - {x} / 2 - lgamma({df} / 2.0 + i + 1))) END FROM range({terms}) g(i))")


POSOLOGY = """CASE
  WHEN regexp_matches(freq_code, 'MES') THEN try_cast(regexp_extract(freq_code, '^[0-9]') AS DOUBLE) * 30
  WHEN freq_type = '4' AND regexp_matches(freq_code, '^SET') THEN 7.0
  WHEN freq_type = '4' AND regexp_matches(freq_code, '[0-9]+SET') THEN try_cast(regexp_extract(freq_code, '^[0-9]+') AS DOUBLE) * 7
  WHEN freq_type = '4' AND regexp_matches(freq_code, 'D[MT]|[0-9]+D') THEN try_cast(regexp_extract(freq_code, '^[0-9]+') AS DOUBLE)
  WHEN freq_type = '4' AND regexp_matches(freq_code, '^[0-9]+[MTN]') THEN try_cast(regexp_extract(freq_code, '^[0-9]+') AS DOUBLE) / 24
  WHEN freq_type = '4' AND regexp_matches(freq_code, '^[0-9]+$') THEN try_cast(freq_code AS DOUBLE)
  WHEN freq_type = '7' THEN 1.0
  WHEN freq_type = '5' AND regexp_matches(freq_desc, '^c/[0-9]+h') THEN floor(try_cast(regexp_extract(freq_desc, '[0-9]+') AS DOUBLE) / 24 * 100 + 0.5) / 100
  WHEN freq_type = '5' AND regexp_matches(freq_code, '^(LU|MA|MI|JU|VI|SA|DO|SET)') THEN 7.0
  WHEN freq_type = '5' AND regexp_matches(freq_code, '^A[0-9]+|^[EDNS]S?$') THEN 1.0
  WHEN freq_type = '5' AND regexp_matches(freq_code, 'EDS') THEN 0.3
  WHEN freq_type = '5' AND regexp_matches(freq_code, '[0-9]+-[0-9]+') THEN 0.5
  WHEN freq_type = '5' AND regexp_matches(freq_code, '^[0-9]+SET') THEN floor(7 / try_cast(regexp_extract(freq_desc, '^[0-9]+') AS DOUBLE) * 10 + 0.5) / 10
  WHEN freq_type = '6' AND regexp_matches(freq_code, '[0-9]+') THEN floor(24 / try_cast(regexp_extract(freq_desc, '[0-9]+') AS DOUBLE) * 10 + 0.5) / 10
  WHEN freq_type = '0' AND regexp_matches(freq_code, '1 DOSIS') THEN 1.0 END"""

AGES = ("Menors de 20 anys", "20-40 anys", "41-50 anys", "51-60 anys", "61-70 anys",
        "71-80 anys", ">80 anys", "Edat no disponible")
AGE_NAMES = ("under_20", "from_20_to_40", "from_41_to_50", "from_51_to_60", "from_61_to_70",
             "from_71_to_80", "over_80", "unavailable")
AGE_BAND = ("CASE WHEN age < 20 THEN 'Menors de 20 anys' WHEN age <= 40 THEN '20-40 anys' "
            "WHEN age <= 50 THEN '41-50 anys' WHEN age <= 60 THEN '51-60 anys' "
            "WHEN age <= 70 THEN '61-70 anys' WHEN age <= 80 THEN '71-80 anys' "
            "WHEN age > 80 THEN '>80 anys' ELSE 'Edat no disponible' END")
AGE_ORDER = "CASE age_band " + " ".join(
    f"WHEN '{a}' THEN {i}" for i, a in enumerate(AGES, 1)) + " END"
CLASSES = (("<0.5", "below_05"), ("0.5-0.8", "05_to_08"), ("0.8-0.9", "08_to_09"),
           (">=0.9", "from_09"))
ROW = "nhc, process_id, step_ts, step_no, tie1, tie2, tie3"
DROW = ("nhc, med_code, med_name, national_code, dispensed_at, qty, tie1, tie2, tie3, tie4, tie5")
PROW = "prescription_id, presc_national_code, dose, freq_code, posology_days, valid_from, valid_to"
STEP_ORDER = "step_ts NULLS LAST, step_no, tie1, tie2, tie3"


def adapter(name: str) -> str:
    text, tables = star.ADAPTERS[name]
    return text.format(**{t: t for t in tables})


# Named intermediate tables: (tables needed, text) -----------------------------------

def _valid(rows: str, presc: str) -> str:
    return f"""SELECT DISTINCT d.nhc, d.med_code, d.med_group, d.med_name, d.national_code,
  d.dispensed_at, d.qty, p.freq_desc, p.posology_days, p.valid_from, p.valid_to
  FROM {rows} d JOIN {presc} p ON d.nhc = p.nhc AND d.med_code = p.med_code
  WHERE d.dispensed_at >= p.valid_from AND d.dispensed_at <= coalesce(p.valid_to, {AS_OF})"""


_CLASS = ("CASE WHEN days = 1 THEN 'Consum únic' WHEN coverage >= 0.9 THEN '>=0.9' "
          "WHEN coverage >= 0.8 THEN '0.8-0.9' WHEN coverage >= 0.5 THEN '0.5-0.8' "
          "WHEN coverage < 0.5 THEN '<0.5' END")

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    **{name: ((), adapter(name)) for name in star.ADAPTERS},
    "stepw": (("steps",), f"""SELECT *, row_number() OVER w AS rn, count(*) OVER p AS n,
  first_value(score) OVER w AS first_score, first_value(step_ts) OVER w AS first_ts,
  min(score) OVER p AS min_score, count(score) OVER p AS n_scores,
  lag(step_ts) OVER w AS previous_ts, lag(score) OVER w AS previous_score
  FROM steps WINDOW w AS (PARTITION BY nhc, process_id ORDER BY {STEP_ORDER}),
  p AS (PARTITION BY nhc, process_id)"""),
    "stepd": (("stepw",), f"""SELECT *, score - first_score AS difference, score < 3.2 AS low,
  {whole_months('first_ts', 'step_ts')} AS months_since_first FROM stepw"""),
    "pure": (("steps",), """SELECT nhc, CASE WHEN count(DISTINCT coalesce(drug_code, '?')) = 1
  THEN 'Si' ELSE 'No' END AS pure_treatment FROM steps GROUP BY nhc"""),
    "proc": (("stepd", "pure"), f"""SELECT nhc, process_id, any_value(n) AS n,
  CASE WHEN count(difference) = count(*) THEN coalesce(min(difference) FILTER (WHERE difference <> 0), 'Infinity') END AS best,
  {days('min(first_ts)', 'arg_min(step_ts, rn) FILTER (WHERE score = min_score)')} AS days_to_minimum,
  CASE WHEN bool_or(rn = 1 AND low) OR bool_or(months_since_first = 0 AND low) THEN 'Si'
   WHEN bool_or(rn = 1 AND low IS NULL) OR bool_or((months_since_first = 0 AND low) IS NULL) THEN NULL
   ELSE 'No' END AS start_error FROM stepd GROUP BY nhc, process_id"""),
    "outc": (("proc", "pure"), """SELECT nhc, process_id, n, days_to_minimum, start_error,
  pure_treatment, best, CASE WHEN n = 1 THEN 'Sense seguiment' WHEN best < 0 THEN 'Èxit'
   WHEN isinf(best) THEN 'Sense canvis' WHEN best > 0 THEN 'Fracàs' END AS result
  FROM proc JOIN pure USING (nhc)"""),
    "frame": (("stepd", "outc"), f"""SELECT s.*, CAST(year(process_start) AS INT) AS start_year,
  {band('s.score')} AS activity, o.result, o.days_to_minimum, o.start_error, o.pure_treatment
  FROM stepd s JOIN outc o USING (nhc, process_id) WHERE s.score <= 10"""),
    "clean": (("frame",), "SELECT * FROM frame WHERE pure_treatment = 'Si' AND start_error = 'No'"),
    "cleanproc": (("frame", "outc", "clean"), """SELECT DISTINCT nhc, process_id, cip, start_year, drug_name,
  indication_code, indication_name, n, result, days_to_minimum FROM clean"""),
    "summ": (("cleanproc",), f"""SELECT *, {rnd('100.0 * n_success / total', 1)} AS unused,
  {rnd('n_success / total * 100', 1)} AS pct_success, {rnd('n_failure / total * 100', 1)} AS pct_failure,
  {rnd('n_no_change / total * 100', 1)} AS pct_no_change
  FROM (SELECT *, nullif(CAST(n_success + n_failure + n_no_change AS DOUBLE), 0) AS total FROM (
   SELECT start_year, drug_name, indication_code, indication_name,
   CASE WHEN count(result) = count(*) THEN count(*) FILTER (WHERE result = 'Èxit') END AS n_success,
   CASE WHEN count(result) = count(*) THEN count(*) FILTER (WHERE result = 'Fracàs') END AS n_failure,
   CASE WHEN count(result) = count(*) THEN count(*) FILTER (WHERE result = 'Sense canvis') END AS n_no_change,
   {rnd("avg(days_to_minimum) FILTER (WHERE result = 'Èxit')", 1)} AS mean_days_to_minimum
   FROM cleanproc WHERE n > 1 GROUP BY ALL))"""),
    "roll": (("summ",), f"""SELECT start_year, drug_name, n_success, n_failure, n_no_change,
  {rnd('n_success * 100.0 / total', 1)} AS pct_success, {rnd('n_failure * 100.0 / total', 1)} AS pct_failure,
  {rnd('n_no_change * 100.0 / total', 1)} AS pct_no_change
  FROM (SELECT *, nullif(CAST(n_success + n_failure + n_no_change AS DOUBLE), 0) AS total FROM (
   SELECT start_year, drug_name,
   CASE WHEN count(n_success) = count(*) THEN CAST(sum(n_success) AS BIGINT) END AS n_success,
   CASE WHEN count(n_failure) = count(*) THEN CAST(sum(n_failure) AS BIGINT) END AS n_failure,
   CASE WHEN count(n_no_change) = count(*) THEN CAST(sum(n_no_change) AS BIGINT) END AS n_no_change
   FROM summ WHERE start_year BETWEEN {Y - 4} AND {Y - 1} GROUP BY ALL))"""),
    "span": (("stepw",), f"""SELECT DISTINCT nhc, process_id, first_followup, last_followup,
  {days('first_followup', 'last_followup')} AS followup_days, CAST(year(process_start) AS INT) AS start_year,
  process_start, process_end, cip, drug_code, drug_name
  FROM (SELECT *, first_value(step_ts) OVER w AS first_followup, last_value(step_ts) OVER w AS last_followup
   FROM steps WINDOW w AS (PARTITION BY nhc, process_id ORDER BY {STEP_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WHERE year(process_start) BETWEEN {Y - 3} AND {Y}"""),
    "points": (("clean",), """SELECT drug_code, score AS y, CAST(months_since_first AS DOUBLE) AS x, months_since_first AS m
  FROM clean WHERE result = 'Èxit'"""),
    "fit": (("points",), """SELECT drug_code, n, mean_months, slope, intercept, r_squared, sxx, syy, sxy, r, max_months,
  CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) END AS residual_sd
  FROM (SELECT drug_code, CAST(regr_count(y, x) AS BIGINT) AS n, regr_avgx(y, x) AS mean_months, regr_slope(y, x) AS slope,
   regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
   regr_sxy(y, x) AS sxy, corr(y, x) AS r, max(m) AS max_months FROM points GROUP BY drug_code)"""),
    "fallfit": (("points",), """SELECT drug_code, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, max(m) AS max_months
  FROM (SELECT drug_code, x, m, 5.0 - 0.2 * m + y / 100.0 AS y FROM points) GROUP BY drug_code"""),
    "fallcurve": (("fallfit",), """SELECT drug_code, CAST(g.m AS INT) AS month, intercept + slope * g.m AS predicted
  FROM fallfit, LATERAL (SELECT unnest(range(0, max_months + 1)) AS m) g"""),
    "curve": (("fit",), """SELECT drug_code, CAST(g.m AS INT) AS month, intercept + slope * g.m AS predicted
  FROM fit, LATERAL (SELECT unnest(range(0, max_months + 1)) AS m) g"""),
    "disp": (("dispensings",), "SELECT * EXCLUDE (nhc_raw), regexp_replace(nhc_raw, '^0+', '') AS nhc FROM dispensings WHERE qty <> 0"),
    "presc": (("prescriptions",), f"SELECT *, {POSOLOGY} AS posology_days FROM prescriptions"),
    "valid": (("disp", "presc"), _valid("disp", "presc")),
    "ratio": (("valid",), f"""SELECT * FROM (SELECT *, CASE WHEN days <> 0 THEN {rnd('r', 1)} END AS coverage_posology FROM (
   SELECT *, CASE WHEN posology_days = 0 THEN 0.0 ELSE units / (1.0 / posology_days) END / nullif(days, 0) AS r FROM (
    SELECT *, sum(qty) OVER g AS units, {days('min(dispensed_at) OVER g', 'max(dispensed_at) OVER g')} AS days
    FROM valid WINDOW g AS (PARTITION BY nhc, national_code, posology_days)))) WHERE coverage_posology IS NOT NULL"""),
    "treat": (("ratio",), """SELECT DISTINCT nhc, med_code, med_group, med_name, national_code, freq_desc, posology_days,
  valid_from, valid_to, units, days, coverage_posology, coverage FROM (SELECT *,
   floor(sum(CAST(round(coverage_posology * 10) AS BIGINT)) OVER s / CAST(count(*) OVER s AS DOUBLE) + 0.5) / 10 AS coverage
   FROM ratio WINDOW s AS (PARTITION BY nhc, national_code))"""),
    "rated": (("treat",), f"""SELECT *, CAST(CASE coverage_class WHEN '<0.5' THEN 1 WHEN '0.5-0.8' THEN 2 WHEN '0.8-0.9' THEN 3 ELSE 4 END AS INT) AS class_order
  FROM (SELECT *, {_CLASS} AS coverage_class FROM treat) WHERE coverage_class <> 'Consum únic'"""),
    "bygroup": (("rated",), """SELECT *, CASE WHEN n > 3 THEN 'n=' || n END AS label_text,
  CAST(sum(n) OVER (PARTITION BY med_group) AS BIGINT) AS total
  FROM (SELECT med_group, coverage_class, class_order, count(*) AS n FROM rated GROUP BY ALL)"""),
    "fine": (("dispensings_fine",), "SELECT * EXCLUDE (nhc_raw), regexp_replace(nhc_raw, '^0+', '') AS nhc FROM dispensings_fine WHERE qty <> 0"),
    "finepresc": (("prescriptions_fine",), f"SELECT *, {POSOLOGY} AS posology_days FROM prescriptions_fine"),
    "finevalid": (("fine", "finepresc"), _valid("fine", "finepresc")),
    "naive": (("finevalid",), """SELECT * FROM finevalid WHERE nhc IN (SELECT nhc FROM finevalid
  GROUP BY nhc HAVING count(DISTINCT med_group) = 1)"""),
    "cohort": (("naive", "patients"), f"""SELECT *, CAST({AGE_ORDER} AS INT) AS age_order FROM (SELECT *, {AGE_BAND} AS age_band FROM (
   SELECT *, start_year - birth_year AS age FROM (SELECT n.*, p.sex, p.birth_year,
    CAST(year(min(dispensed_at) OVER (PARTITION BY n.nhc)) AS INT) AS start_year
    FROM naive n LEFT JOIN (SELECT DISTINCT nhc, sex, birth_year FROM patients) p ON n.nhc = p.nhc)))"""),
    "bydrug": (("cohort",), f"""SELECT med_group, patients, {rnd('patients / (sum(patients) OVER ())::DOUBLE * 100', 1)} AS pct
  FROM (SELECT med_group, count(DISTINCT nhc) AS patients FROM cohort GROUP BY med_group)"""),
    "ranked": (("bydrug",), """SELECT med_group, patients, CAST(row_number() OVER (ORDER BY patients DESC, med_group) AS INT) AS position
  FROM bydrug WHERE patients > 100"""),
    "times": (("cohort",), f"""SELECT * EXCLUDE (first_at, previous_at),
  CASE WHEN previous_at IS NULL THEN 0.0 ELSE {rnd(months('first_at', 'previous_at'), 2)} END AS months
  FROM (SELECT *, min(dispensed_at) OVER (PARTITION BY nhc, med_group) AS first_at, lag(dispensed_at) OVER w AS previous_at,
   lead(1) OVER w IS NULL AS is_last FROM cohort WINDOW w AS (PARTITION BY nhc, med_group ORDER BY dispensed_at NULLS LAST,
   med_code NULLS LAST, med_name NULLS LAST, national_code NULLS LAST, qty NULLS LAST, freq_desc NULLS LAST,
   posology_days NULLS LAST, valid_from NULLS LAST, valid_to NULLS LAST, start_year, sex NULLS LAST, birth_year NULLS LAST))"""),
    "counts": (("times",), """SELECT med_group, months, count(*) AS n, CAST(sum(is_last::INT) AS BIGINT) AS d
  FROM times GROUP BY med_group, months"""),
    "km": (("counts", "ranked"), """SELECT med_group, months, CAST(at_risk AS BIGINT) AS at_risk, d AS events, n - d AS censored,
  product(1 - d / at_risk::DOUBLE) OVER (PARTITION BY med_group ORDER BY months ROWS UNBOUNDED PRECEDING) AS survival,
  CAST(sum(d) OVER (PARTITION BY med_group ORDER BY months ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_events
  FROM (SELECT *, sum(n) OVER (PARTITION BY med_group ORDER BY months ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk
   FROM counts JOIN ranked USING (med_group) WHERE position <= 4)"""),
    "allkm": (("counts", "ranked"), """SELECT med_group, months, CAST(at_risk AS BIGINT) AS at_risk, d AS events, n - d AS censored,
  product(1 - d / at_risk::DOUBLE) OVER (PARTITION BY med_group ORDER BY months ROWS UNBOUNDED PRECEDING) AS survival,
  CAST(sum(d) OVER (PARTITION BY med_group ORDER BY months ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_events
  FROM (SELECT *, sum(n) OVER (PARTITION BY med_group ORDER BY months ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk
   FROM counts JOIN ranked USING (med_group))"""),
    "allgrid": (("counts", "ranked"), """SELECT *, sum(r) OVER t AS rt, sum(d) OVER t AS dt FROM (
   SELECT t.months, g.position, g.med_group, coalesce(c.n, 0) AS n, coalesce(c.d, 0) AS d,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.position ORDER BY t.months ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
   FROM (SELECT DISTINCT c.months FROM ranked JOIN counts c USING (med_group)) t CROSS JOIN ranked g
   LEFT JOIN counts c ON c.med_group = g.med_group AND c.months = t.months) WINDOW t AS (PARTITION BY months)"""),
    "alloe": (("allgrid",), """SELECT 'all' AS comparison, CAST(position AS INT) AS position, med_group, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(d) AS BIGINT) AS observed, sum(dt * r / rt::DOUBLE) AS expected FROM allgrid GROUP BY ALL"""),
    "allcov": (("allgrid",), """SELECT 'all' AS comparison, CAST(a.position AS INT) AS p, CAST(b.position AS INT) AS q, sum(CASE WHEN a.rt > 1 THEN
   a.dt * (a.rt - a.dt) / (a.rt - 1.0) * (a.r / a.rt::DOUBLE) * ((a.position = b.position)::INT - b.r / b.rt::DOUBLE) ELSE 0 END) AS covariance
  FROM allgrid a JOIN allgrid b USING (months) GROUP BY ALL"""),
    "sets": ((), """SELECT * FROM (VALUES ('1_2_3_4', 1), ('1_2_3_4', 2), ('1_2_3_4', 3), ('1_2_3_4', 4), ('1_2', 1), ('1_2', 2),
  ('1_3', 1), ('1_3', 3), ('1_4', 1), ('1_4', 4)) s(comparison, position)"""),
    "grid": (("counts", "ranked", "sets"), """SELECT t.comparison, t.months, g.position, g.med_group,
  coalesce(c.n, 0) AS n, coalesce(c.d, 0) AS d,
  sum(coalesce(c.n, 0)) OVER (PARTITION BY t.comparison, g.position ORDER BY t.months ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
  FROM (SELECT DISTINCT s.comparison, c.months FROM sets s JOIN ranked USING (position) JOIN counts c USING (med_group)) t
  JOIN (SELECT comparison, position, med_group FROM sets JOIN ranked USING (position)) g USING (comparison)
  LEFT JOIN counts c ON c.med_group = g.med_group AND c.months = t.months"""),
    "gridt": (("grid",), """SELECT *, sum(r) OVER t AS rt, sum(d) OVER t AS dt FROM grid
  WINDOW t AS (PARTITION BY comparison, months)"""),
    "oe": (("gridt",), """SELECT comparison, CAST(position AS INT) AS position, med_group, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(d) AS BIGINT) AS observed, sum(dt * r / rt::DOUBLE) AS expected FROM gridt GROUP BY ALL"""),
    "cov": (("gridt",), """SELECT a.comparison, a.position AS p, b.position AS q, sum(CASE WHEN a.rt > 1 THEN
   a.dt * (a.rt - a.dt) / (a.rt - 1.0) * (a.r / a.rt::DOUBLE) * ((a.position = b.position)::INT - b.r / b.rt::DOUBLE) ELSE 0 END) AS v
  FROM gridt a JOIN gridt b USING (comparison, months) GROUP BY ALL"""),
    "people": (("cohort",), """SELECT nhc, med_group, sex, age, age_band, age_order, count(*) AS n_rows FROM cohort GROUP BY ALL"""),
    "lines": (("fine",), f"""SELECT nhc, med_group, position, {rnd(months('first_at', 'last_at'), 1)} AS months FROM (
   SELECT *, CAST(row_number() OVER (PARTITION BY nhc ORDER BY first_rn) AS INT) AS position, count(*) OVER (PARTITION BY nhc) AS k FROM (
    SELECT nhc, med_group, min(rn) AS first_rn, min(dispensed_at) AS first_at, max(dispensed_at) AS last_at FROM (
     SELECT *, row_number() OVER (PARTITION BY nhc ORDER BY dispensed_at, tie2, tie3, tie4, tie5, med_group) AS rn FROM fine)
    GROUP BY nhc, med_group)) WHERE k > 1"""),
    "paths": (("lines",), """SELECT nhc, string_agg(med_group, '+' ORDER BY position) AS path,
  list(med_group ORDER BY position) AS drugs, list(months ORDER BY position) AS durations FROM lines GROUP BY nhc"""),
    "freq": (("paths",), "SELECT path, count(*) AS n FROM paths GROUP BY path"),
    "vectors": (("paths",), """SELECT path, v.drugs AS drugs, v.durations AS durations FROM (
   SELECT DISTINCT path, {'drugs': drugs, 'durations': durations} AS v FROM paths)"""),
    "hub": (("disp", "presc"), f"""SELECT d.*, p.presc_nhc_raw, p.dose, p.freq_code, p.freq_desc FROM disp d
  LEFT JOIN presc p ON d.nhc = p.nhc AND d.med_code = p.med_code"""),
    "dosed": (("hub",), f"""SELECT h.*, n.naive, o.dose_optimised FROM hub h
  JOIN (SELECT presc_nhc_raw, CASE WHEN count(DISTINCT med_group) = 1 THEN 'Si' ELSE 'No' END AS naive FROM hub GROUP BY presc_nhc_raw) n
   ON h.presc_nhc_raw IS NOT DISTINCT FROM n.presc_nhc_raw
  JOIN (SELECT presc_nhc_raw, med_code, CASE WHEN count(DISTINCT (dose, freq_code)) = 1 THEN 'No' ELSE 'Si' END AS dose_optimised
   FROM hub WHERE med_group = '{DOSE_DRUG}' GROUP BY ALL) o
   ON h.presc_nhc_raw IS NOT DISTINCT FROM o.presc_nhc_raw AND h.med_code = o.med_code
  WHERE h.med_group = '{DOSE_DRUG}'"""),
    "variants": (("dosed",), """SELECT DISTINCT nhc, med_code, med_name, dose, freq_code, freq_desc,
  med_name || '_' || coalesce(CAST(dose AS VARCHAR), 'NA') || '_' || coalesce(freq_code, 'NA') AS variant
  FROM dosed WHERE dose_optimised = 'Si'"""),
    "pervariant": (("variants",), """SELECT nhc, list(variant ORDER BY med_code, med_name, dose, freq_code) AS v,
  string_agg(variant, ' + ' ORDER BY med_code, med_name, dose, freq_code) AS combination
  FROM (SELECT DISTINCT nhc, variant, med_code, med_name, dose, freq_code FROM variants) GROUP BY nhc"""),
}


def _wide(keys: str, total: str, source: str) -> str:
    counts = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE coverage_class = '{c}'), 0) AS BIGINT) AS n_{k}"
                       for c, k in CLASSES)
    shares = ", ".join(f"{pct_text(rnd(f'(n_{k} / {total}::DOUBLE * 100)', 1))} AS pct_{k}" for _, k in CLASSES)
    return (f"SELECT *, {shares} FROM (SELECT {keys}, {counts}, CAST(sum(n) AS BIGINT) AS {total} "
            f"FROM ({source}) GROUP BY ALL)")


_BYDRUG = "SELECT med_group, med_name, coverage_class, class_order, count(*) AS n FROM rated GROUP BY ALL"


def _spread_totals(column: str, names: list[tuple[str, str]], missing: str | None) -> str:
    wide = [f"count(DISTINCT nhc) FILTER (WHERE {column} = '{v}') AS {n}" for v, n in names]
    if missing:
        wide.append(f"count(DISTINCT nhc) FILTER (WHERE {column} IS NULL) AS {missing}")
    body = f"SELECT med_group, {', '.join(wide)} FROM cohort GROUP BY med_group"
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}"
                     for n in [n for _, n in names] + ([missing] if missing else []))
    return (f"SELECT * FROM (WITH w AS ({body}) SELECT * FROM w "
            f"UNION ALL BY NAME SELECT 'Totals' AS med_group, {sums} FROM w)")


def _cells(column: str, levels) -> str:
    values = ", ".join(f"('{v}')" for v in levels)
    return (f"SELECT g.med_group, l.level, CAST(coalesce(sum(c.n_rows), 0) AS BIGINT) AS n "
            f"FROM (SELECT DISTINCT med_group FROM people WHERE {column} IS NOT NULL AND med_group <> '{EXCLUDED_DRUG}') g "
            f"CROSS JOIN (VALUES {values}) l(level) LEFT JOIN people c ON c.med_group = g.med_group AND c.{column} = l.level "
            f"GROUP BY ALL")


def _independence(cells: str) -> str:
    return f"""SELECT {rnd('chisq', 6)} AS chisq, df, {rnd(chisq_tail('chisq', 'df'), 6)} AS p_value FROM (
  SELECT sum((n - e) * (n - e) / e) AS chisq, (count(DISTINCT med_group) - 1) * (count(DISTINCT level) - 1) AS df FROM (
   SELECT *, sum(n) OVER (PARTITION BY med_group) * (sum(n) OVER (PARTITION BY level))::DOUBLE / sum(n) OVER () AS e FROM ({cells})) WHERE e > 0)"""


def _normalised(names: str) -> str:
    return ", ".join(f"{rnd(n, 6)} AS {n}" for n in names.split())


_T975 = """(1.959963984540054e0 + (power(1.959963984540054e0, 3) + 1.959963984540054e0) / (4.0 * v)
  + (5 * power(1.959963984540054e0, 5) + 16 * power(1.959963984540054e0, 3) + 3 * 1.959963984540054e0) / (96.0 * v * v)
  + (3 * power(1.959963984540054e0, 7) + 19 * power(1.959963984540054e0, 5) + 17 * power(1.959963984540054e0, 3) - 15 * 1.959963984540054e0) / (384.0 * v * v * v)
  + (79 * power(1.959963984540054e0, 9) + 776 * power(1.959963984540054e0, 7) + 1482 * power(1.959963984540054e0, 5)
   - 1920 * power(1.959963984540054e0, 3) - 945 * 1.959963984540054e0) / (92160.0 * v * v * v * v))"""

_LOGRANK = f"""SELECT * FROM (WITH d AS (SELECT comparison, position AS p, observed - expected AS z FROM oe),
 z AS (SELECT comparison, max(z) FILTER (WHERE p = a) AS z1, max(z) FILTER (WHERE p = b) AS z2, max(z) FILTER (WHERE p = c) AS z3
  FROM d JOIN (VALUES ('1_2_3_4', 1, 2, 3), ('1_2', 1, 0, 0), ('1_3', 1, 0, 0), ('1_4', 1, 0, 0)) s(comparison, a, b, c) USING (comparison) GROUP BY comparison),
 m AS (SELECT comparison, max(v) FILTER (WHERE p = 1 AND q = 1) AS a, max(v) FILTER (WHERE p = 1 AND q = 2) AS b, max(v) FILTER (WHERE p = 1 AND q = 3) AS c,
  max(v) FILTER (WHERE p = 2 AND q = 2) AS d, max(v) FILTER (WHERE p = 2 AND q = 3) AS e, max(v) FILTER (WHERE p = 3 AND q = 3) AS f FROM cov GROUP BY comparison),
 k AS (SELECT comparison, CAST(count(*) AS INT) AS k FROM oe WHERE n > 0 GROUP BY comparison),
 x AS (SELECT comparison, CASE WHEN k = 2 THEN z1 * z1 / a
   WHEN k = 3 THEN (z1 * z1 * d - 2 * z1 * z2 * b + z2 * z2 * a) / (a * d - b * b)
   WHEN k = 4 THEN (z1 * z1 * (d * f - e * e) + z2 * z2 * (a * f - c * c) + z3 * z3 * (a * d - b * b)
    + 2 * z1 * z2 * (c * e - b * f) + 2 * z1 * z3 * (b * e - c * d) + 2 * z2 * z3 * (b * c - a * e))
   / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) END AS chisq,
  k - 1 AS df FROM z JOIN m USING (comparison) JOIN k USING (comparison))
 SELECT comparison, {rnd('chisq', 6)} AS chisq, df, {rnd(chisq_tail('chisq', 'df'), 6)} AS p_value FROM x)"""


# The drugs but the last one with rows, by Gaussian elimination of the covariances with the distances behind them.
_LOGRANK_ALL = f"""SELECT * FROM (WITH RECURSIVE own AS (SELECT position, row_number() OVER (ORDER BY position) AS i,
  count(*) OVER () AS k, observed - expected AS z FROM alloe WHERE n > 0),
 cells AS (SELECT a.i, a.k, a.z, list(c.covariance ORDER BY b.i) AS v FROM own a JOIN own b ON b.i < b.k
  JOIN allcov c ON c.p = a.position AND c.q = b.position WHERE a.i < a.k GROUP BY ALL),
 start AS (SELECT list(list_append(v, z) ORDER BY i) AS m, list(z ORDER BY i) AS z, any_value(k) AS k FROM cells),
 steps AS (SELECT 0 AS c, m, z, k FROM start UNION ALL
  SELECT c + 1, list_transform(m, lambda row, i: CASE WHEN i = c + 1 THEN row ELSE
    list_transform(row, lambda x, j: x - row[c + 1] / m[c + 1][c + 1] * m[c + 1][j]) END), z, k
  FROM steps WHERE c + 1 < k),
 x AS (SELECT list_sum(list_transform(z, lambda y, i: y * m[i][k] / m[i][i])) AS chisq, CAST(k - 1 AS INT) AS df
  FROM steps WHERE c + 1 = k)
 SELECT 'all' AS comparison, {rnd('chisq', 6)} AS chisq, df, {rnd(chisq_tail('chisq', 'df'), 6)} AS p_value FROM x)"""


# Query: (tables needed, final select) ------------------------------------------------

SELECTS: dict[str, tuple[tuple[str, ...], str]] = {
    "scan_delimited": (("dispensings",), """SELECT nhc_raw, med_code, med_name, med_group, CAST(tie1 AS VARCHAR) AS episode,
  national_code, dispensed_at, qty FROM dispensings WHERE CAST(nhc_raw AS BIGINT) % 50 <> 0"""),
    "scan_steps": (("steps",), """SELECT CASE WHEN CAST(nhc AS BIGINT) % 10 <> 0 THEN nhc END AS nhc, cip, process_id, drug_code, drug_name,
  process_start, CASE WHEN process_id % 5 <> 0 THEN process_end END AS process_end, step_ts,
  CAST(step_no AS INT) AS step_no, score, CAST(tie1 AS VARCHAR) AS step_code FROM steps"""),
    "scan_prescriptions": (("presc",), """SELECT presc_nhc_raw, nhc, prescription_id, med_code, presc_national_code,
  CAST(dose AS DOUBLE) AS dose, freq_type, freq_code, freq_desc, valid_from, valid_to, posology_days FROM presc
  WHERE CAST(presc_nhc_raw AS BIGINT) % 50 <> 0"""),
    "typed_projection": (("dispensings",), """SELECT nhc_raw AS nhc, dispensed_at AS data_consum, qty AS valor,
  med_name AS medicament, CAST(tie1 AS VARCHAR) AS episodi FROM dispensings"""),
    "valid_ids": (("dispensings",), """SELECT nhc_raw, med_name, dispensed_at, qty, tie1, tie2 FROM dispensings
  WHERE CAST(nhc_raw AS BIGINT) % 50 <> 0 AND CAST(nhc_raw AS BIGINT) % 77 <> 0"""),
    "activity_band": (("steps",), f"SELECT {ROW}, score, {band('score')} AS activity FROM steps"),
    "activity_band_uncapped": (("steps",), f"SELECT {ROW}, score, {band('score', False)} AS activity FROM steps"),
    "outlier_split": (("steps",), f"""SELECT {ROW}, score, CASE WHEN score > 10 THEN 'outlier' ELSE 'kept' END AS part
  FROM steps WHERE score IS NOT NULL"""),
    "baseline_difference": (("frame",), f"SELECT {ROW}, score, difference FROM frame"),
    "months_since_first": (("frame",), f"SELECT {ROW}, months_since_first FROM frame"),
    "days_to_minimum": (("proc",), "SELECT nhc, process_id, n, days_to_minimum FROM proc"),
    "start_error": (("proc",), "SELECT nhc, process_id, start_error FROM proc"),
    "pure_treatment": (("pure",), "SELECT * FROM pure"),
    "process_outcomes": (("frame",), f"""SELECT DISTINCT nhc, process_id, cip, start_year, drug_name, indication_code,
  indication_name, n, result, days_to_minimum, start_error, pure_treatment, isinf(best) AS unchanged,
  CASE WHEN NOT isinf(best) THEN {rnd('best', 6)} END AS best_change FROM frame JOIN (SELECT nhc, process_id, best FROM outc) USING (nhc, process_id)"""),
    "clean_cohort": (("clean",), f"""SELECT {ROW}, drug_name, start_year, score, activity, difference,
  months_since_first, n, result, days_to_minimum FROM clean"""),
    "qc_start_in_remission": (("frame",), f"""SELECT start_year, nhc, cip, process_id, drug_name, step_no, step_ts, score, activity, result
  FROM (SELECT *, first_value(score) OVER (PARTITION BY nhc ORDER BY process_id, {STEP_ORDER}) AS opening FROM frame WHERE n > 1) WHERE opening < 2.6"""),
    "followup_gaps": (("stepw",), f"""SELECT {ROW}, CAST(year(process_start) AS INT) AS start_year, drug_name,
  {days('previous_ts', 'step_ts')} AS gap_days FROM stepw WHERE year(process_start) BETWEEN {Y - 3} AND {Y}"""),
    "followup_span": (("span",), "SELECT * FROM span"),
    "process_timeline": (("span",), f"""SELECT nhc, process_id, drug_name, followup_days, 'process_start' AS kind,
  CAST(CAST(process_start AS DATE) AS VARCHAR) AS date, NULL::VARCHAR AS label FROM span WHERE start_year = {TIMELINE_YEAR}
  UNION ALL SELECT nhc, process_id, drug_name, followup_days, 'process_end', CAST(CAST(process_end AS DATE) AS VARCHAR),
  CASE WHEN followup_days > 0 THEN followup_days || ' dies' END FROM span WHERE start_year = {TIMELINE_YEAR}"""),
    "step_changes": (("stepw",), f"""SELECT {ROW}, CAST(year(process_start) AS INT) AS start_year, {band('score', False)} AS activity,
  {rnd('(score - previous_score)', 6)} AS step_change, {rnd('span_change', 6)} AS span_change,
  CASE WHEN span_change < 0 THEN 'Exit' WHEN span_change >= 0 THEN 'Fracàs' END AS span_result,
  {whole_months('previous_ts', 'step_ts')} AS gap_months, {whole_months('first_ts', 'last_ts')} AS span_months,
  {days('first_ts', 'last_ts', 604_800_000_000.0)} AS span_weeks
  FROM (SELECT *, CASE WHEN n_scores = n THEN first_score - min_score END AS span_change,
   max(step_ts) OVER (PARTITION BY nhc, process_id) AS last_ts FROM stepw)"""),
    "year_window_completed": (("cleanproc",), f"""SELECT nhc, process_id, start_year, drug_name, result FROM cleanproc
  WHERE start_year BETWEEN {Y - 4} AND {Y - 1}"""),
    "year_window_current": (("cleanproc",), f"""SELECT nhc, process_id, start_year, drug_name, result FROM cleanproc
  WHERE start_year BETWEEN {Y - 3} AND {Y}"""),
    "cohort_year_range": (("clean",), "SELECT min(start_year) AS first_year, max(start_year) AS last_year FROM clean"),
    "outcome_summary": (("summ",), "SELECT * EXCLUDE (total, unused) FROM summ"),
    "outcome_report": (("summ",), f"""SELECT start_year, drug_name, indication_code, n_success, n_failure, n_no_change, mean_days_to_minimum,
  {pct_text('pct_success')} AS pct_success, {pct_text('pct_failure')} AS pct_failure, {pct_text('pct_no_change')} AS pct_no_change
  FROM summ WHERE start_year BETWEEN {Y - 4} AND {Y - 1}"""),
    "outcome_rollup": (("roll",), "SELECT * FROM roll"),
    "outcome_long": (("roll",), """SELECT start_year, drug_name, result_type, result_order, n, CASE WHEN n > 3 THEN n END AS label,
  CASE WHEN n > 0 THEN 'n=' || n END AS label_text FROM (
   SELECT start_year, drug_name, 'n_no_change' AS result_type, 1 AS result_order, n_no_change AS n FROM roll
   UNION ALL SELECT start_year, drug_name, 'n_failure', 2, n_failure FROM roll
   UNION ALL SELECT start_year, drug_name, 'n_success', 3, n_success FROM roll)"""),
    "trend_fit": (("fit",), f"""SELECT drug_code, n, max_months,
  {_normalised('mean_months slope intercept r_squared sxx syy sxy r residual_sd')} FROM fit"""),
    "trend_moments": (("points",), """SELECT drug_code, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y,
  CAST(sum(x * x) AS BIGINT) AS sum_xx, CAST(sum(x * y) AS BIGINT) AS sum_xy, CAST(sum(y * y) AS BIGINT) AS sum_yy, max_months
  FROM (SELECT drug_code, CAST(m AS HUGEINT) AS x, CAST(round(y * 10000) AS HUGEINT) AS y, max(m) OVER (PARTITION BY drug_code) AS max_months
   FROM points WHERE y IS NOT NULL AND m IS NOT NULL) GROUP BY drug_code, max_months"""),
    "trend_coefficients": (("points", "fit"), f"""SELECT drug_code, n, df, term, {rnd('estimate', 6)} AS estimate, {rnd('std_error', 6)} AS std_error,
  {rnd('(estimate / std_error)', 6)} AS t, {rnd(t_tail('(estimate / std_error)', 'df'), 6)} AS p_value FROM (
   SELECT drug_code, n, n - 2 AS df, 'months' AS term, slope AS estimate, s / sqrt(qx) AS std_error FROM (
    SELECT p.drug_code, any_value(n) AS n, any_value(slope) AS slope, sum((x - mean_months) * (x - mean_months)) AS qx,
     sqrt(sum((y - intercept - slope * x) * (y - intercept - slope * x)) / (any_value(n) - 2)) AS s
    FROM points p JOIN fit f USING (drug_code) WHERE y IS NOT NULL GROUP BY p.drug_code)
   UNION ALL SELECT drug_code, n, n - 2, 'intercept', intercept, s * sqrt(1.0 / n + m * m / qx) FROM (
    SELECT p.drug_code, any_value(n) AS n, any_value(intercept) AS intercept, any_value(mean_months) AS m, sum((x - mean_months) * (x - mean_months)) AS qx,
     sqrt(sum((y - intercept - slope * x) * (y - intercept - slope * x)) / (any_value(n) - 2)) AS s
    FROM points p JOIN fit f USING (drug_code) WHERE y IS NOT NULL GROUP BY p.drug_code))"""),
    "trend_correlation": (("fit",), f"""SELECT drug_code, n, df, {_normalised('r t low high')},
  {rnd(t_tail('t', 'df'), 6)} AS p_value FROM (SELECT drug_code, n, n - 2 AS df, r, r * sqrt((n - 2) / (1 - r * r)) AS t,
   CASE WHEN n > 3 THEN tanh(atanh(r) - 1.959963984540054 / sqrt(greatest(n - 3, 1))) END AS low,
   CASE WHEN n > 3 THEN tanh(atanh(r) + 1.959963984540054 / sqrt(greatest(n - 3, 1))) END AS high FROM fit WHERE n >= 3)"""),
    "trend_prediction": (("curve",), f"SELECT drug_code, month, {rnd('predicted', 6)} AS predicted FROM curve"),
    "threshold_crossing": (("curve",), f"""SELECT drug_code, threshold, month, {rnd('predicted', 6)} AS predicted, activity,
  coalesce(activity, 'NA') || ': ' || month || 'mesos' AS label FROM (
   SELECT c.drug_code, t.threshold, c.month, c.predicted,
    CASE WHEN c.predicted < 2.6 THEN 'Remissió' WHEN c.predicted < 3.2 THEN 'Activ.Baixa' END AS activity
   FROM curve c JOIN (SELECT drug_code, CAST(t AS DOUBLE) AS threshold, min(month) - 1 AS month FROM curve, (VALUES (2.5), (3.1)) v(t)
    WHERE predicted < CAST(t AS DOUBLE) GROUP BY ALL) t ON c.drug_code = t.drug_code AND c.month = t.month)"""),
    "threshold_crossing_falling": (("fallcurve",), f"""SELECT drug_code, threshold, month, {rnd('predicted', 6)} AS predicted, activity,
  coalesce(activity, 'NA') || ': ' || month || 'mesos' AS label FROM (
   SELECT c.drug_code, t.threshold, c.month, c.predicted,
    CASE WHEN c.predicted < 2.6 THEN 'Remissió' WHEN c.predicted < 3.2 THEN 'Activ.Baixa' END AS activity
   FROM fallcurve c JOIN (SELECT drug_code, CAST(t AS DOUBLE) AS threshold, min(month) - 1 AS month FROM fallcurve, (VALUES (2.5), (3.1)) v(t)
    WHERE predicted < CAST(t AS DOUBLE) GROUP BY ALL) t ON c.drug_code = t.drug_code AND c.month = t.month)"""),
    "activity_points": (("points",), f"""SELECT drug_code, m AS months_since_first, y AS score, {band('y')} AS activity FROM points"""),
    "trend_band": (("fit",), f"""SELECT drug_code, month, {rnd('y', 6)} AS predicted, {rnd('(y - h)', 6)} AS low, {rnd('(y + h)', 6)} AS high FROM (
   SELECT drug_code, CAST(g.m AS INT) AS month, intercept + slope * g.m AS y,
    {_T975} * residual_sd * sqrt(1.0 / n + (g.m - mean_months) * (g.m - mean_months) / sxx) AS h
   FROM (SELECT *, n - 2 AS v FROM fit WHERE n > 2) f, LATERAL (SELECT unnest(range(0, max_months + 1)) AS m) g)"""),
    "trend_inverse": (("fit",), f"""SELECT drug_code, CAST(c AS DOUBLE) AS score, {rnd('(intercept + slope * CAST(c AS DOUBLE))', 1)} AS line_value,
  {rnd('((CAST(c AS DOUBLE) - intercept) / slope)', 6)} AS months_to_score FROM fit, (VALUES (2.5), (3.1), (5.0)) v(c)"""),
    "posology_days": (("presc",), """SELECT nhc, med_code, presc_national_code, dose, freq_type, freq_code, freq_desc,
  valid_from, valid_to, posology_days FROM presc"""),
    "qc_prescriptions": (("presc",), "SELECT nhc, med_code, presc_national_code, valid_from, valid_to FROM presc"),
    "dispensing_gaps": (("dispensings",), f"""SELECT * FROM (SELECT regexp_replace(nhc_raw, '^0+', '') AS nhc, med_code, med_name, national_code, dispensed_at, qty,
   tie1, tie2, tie3, tie4, tie5, {days('lag(dispensed_at) OVER w', 'dispensed_at')} AS gap_days FROM dispensings
   WINDOW w AS (PARTITION BY nhc_raw, med_name ORDER BY dispensed_at, tie1, tie2, tie3, tie4, tie5)) WHERE qty <> 0"""),
    "dispensing_prescription_join": (("disp", "presc"), f"""SELECT {', '.join('d.' + c.strip() for c in DROW.split(','))}, {PROW}
  FROM disp d LEFT JOIN presc p ON d.nhc = p.nhc AND d.med_code = p.med_code"""),
    "paired_histories_expanded": (("disp", "presc"), f"""SELECT {', '.join('d.' + c.strip() for c in DROW.split(','))}, {PROW}
  FROM disp d LEFT JOIN presc p ON d.nhc = p.nhc AND d.med_code = p.med_code"""),
    "paired_histories": (("disp", "presc"), """SELECT nhc, med_code, dispensings, coalesce(n, 0) AS prescriptions, coalesce(k, 0) AS identified,
  dispensings * greatest(coalesce(n, 0), 1) AS pairs, coalesce(k, 0) > 0 AS matched, coalesce(n, 0) = 0 OR k < n AS unmatched
  FROM (SELECT nhc, med_code, count(*) AS dispensings FROM disp GROUP BY ALL)
  LEFT JOIN (SELECT nhc, med_code, count(*) AS n, count(prescription_id) AS k FROM presc GROUP BY ALL) USING (nhc, med_code)"""),
    "matched_dispensings": (("disp", "presc"), f"""SELECT {', '.join('d.' + c.strip() for c in DROW.split(','))}, {PROW}
  FROM disp d JOIN presc p ON d.nhc = p.nhc AND d.med_code = p.med_code WHERE prescription_id IS NOT NULL"""),
    "unmatched_dispensings": (("disp", "presc"), f"""SELECT DISTINCT {', '.join('d.' + c.strip() for c in DROW.split(','))}, prescription_id
  FROM disp d LEFT JOIN presc p ON d.nhc = p.nhc AND d.med_code = p.med_code WHERE prescription_id IS NULL"""),
    "valid_dispensings": (("valid",), "SELECT * FROM valid"),
    "interval_join_by_code": (("disp", "presc"), f"""SELECT d.*, p.posology_days, p.valid_from, p.valid_to
  FROM (SELECT DISTINCT nhc, med_code, med_group, med_name, national_code, dispensed_at, qty FROM disp
   WHERE (nhc, med_code) IN (SELECT (nhc, med_code) FROM presc)) d
  JOIN presc p ON CAST(d.nhc AS DOUBLE) = CAST(p.nhc AS DOUBLE) AND d.national_code = p.presc_national_code
  WHERE d.dispensed_at >= p.valid_from AND d.dispensed_at <= coalesce(p.valid_to, {AS_OF})"""),
    "point_in_time_posology": (("disp", "presc"), f"""SELECT nhc, national_code, dispensed_at, posology_days FROM (
   SELECT d.*, p.posology_days, row_number() OVER (PARTITION BY d.nhc, d.national_code, d.dispensed_at
    ORDER BY p.valid_from, p.posology_days NULLS LAST) AS rn
   FROM (SELECT DISTINCT nhc, national_code, dispensed_at FROM disp) d LEFT JOIN presc p
   ON d.nhc = p.nhc AND d.national_code = p.presc_national_code AND d.dispensed_at >= p.valid_from
   AND d.dispensed_at <= coalesce(p.valid_to, {AS_OF})) WHERE rn = 1"""),
    "coverage_ratio": (("treat",), "SELECT * FROM treat"),
    "coverage_class": (("rated",), """SELECT nhc, national_code, med_name, posology_days, valid_from, valid_to, freq_desc, days,
  coverage, coverage_class, class_order FROM rated"""),
    "coverage_detail": (("rated",), """SELECT DISTINCT * EXCLUDE (coverage_posology, class_order) RENAME (posology_days AS prescription_days) FROM rated"""),
    "coverage_by_drug": (("rated",), _BYDRUG),
    "coverage_by_group": (("bygroup",), "SELECT * FROM bygroup"),
    "patients_by_group": (("rated",), "SELECT med_group, count(DISTINCT nhc) AS patients FROM rated GROUP BY med_group"),
    "patients_total": (("rated",), "SELECT 'Numero de pacients totals' AS variable, count(DISTINCT nhc) AS n FROM rated"),
    "coverage_summary": (("bygroup",), f"""SELECT w.*, p.patients, {rnd('(treatments / patients::DOUBLE)', 1)} AS treatments_per_patient
  FROM ({_wide('med_group', 'treatments', 'SELECT * FROM bygroup')}) w
  JOIN (SELECT med_group, count(DISTINCT nhc) AS patients FROM rated GROUP BY med_group) p USING (med_group)"""),
    "coverage_summary_by_drug": (("rated",), _wide("med_group, med_name", "total", _BYDRUG)),
    "round_up_to": (("bygroup",), """SELECT top, breaks, CAST(ceil(top / breaks) * breaks AS BIGINT) AS axis_limit FROM (
  SELECT max(total) AS top, CAST(ceil(max(total) / 100 * 10 / 10) * 10 AS BIGINT) AS breaks FROM bygroup)"""),
    "coverage_drug_totals": (("rated",), f"""SELECT * EXCLUDE (top), CAST(ceil(top / breaks::DOUBLE) * breaks AS BIGINT) AS axis_limit FROM (
  SELECT *, CAST(ceil(top / 100.0 * 10 / 10) * 10 AS BIGINT) AS breaks FROM (
   SELECT *, max(total) OVER (PARTITION BY med_group) AS top FROM (
    SELECT *, CAST(sum(n) OVER (PARTITION BY med_group, med_name) AS BIGINT) AS total FROM ({_BYDRUG}))))"""),
    "qc_overlaps": (("valid",), """SELECT count(*) AS dispensings, count(*) FILTER (WHERE k > 1) AS multiplied,
  CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS added_rows FROM (SELECT nhc, med_code, med_group, med_name, national_code, dispensed_at, qty,
   count(*) AS k FROM valid GROUP BY ALL)"""),
    "naive_patients_total": (("naive",), "SELECT 'Numero de pacients totals' AS variable, count(DISTINCT nhc) AS n FROM naive"),
    "naive_patients": (("naive",), "SELECT * FROM naive"),
    "cohort_demographics": (("cohort",), "SELECT * FROM cohort"),
    "age_band": (("people",), "SELECT nhc, age, age_band, age_order FROM people"),
    "cohort_by_drug": (("bydrug",), """SELECT med_group, patients, pct FROM bydrug UNION ALL
  SELECT 'Totals', CAST(sum(patients) AS BIGINT), sum(CAST(round(pct * 10) AS BIGINT)) / 10.0 FROM bydrug"""),
    "cohort_by_drug_sex": (("cohort",), _spread_totals("sex", [("F", "n_f"), ("M", "n_m")], "n_unknown")),
    "cohort_by_drug_age": (("cohort",), _spread_totals("age_band", list(zip(AGES, AGE_NAMES)), None)),
    "crosstab_drug_sex": (("people",), _cells("sex", ("F", "M"))),
    "crosstab_drug_age": (("people",), _cells("age_band", AGES)),
    "chisq_drug": (("cohort",), f"""SELECT {rnd('chisq', 6)} AS chisq, df, {rnd(chisq_tail('chisq', 'df'), 6)} AS p_value FROM (
  SELECT sum((n - e) * (n - e) / e) AS chisq, count(*) - 1 AS df FROM (
   SELECT count(*) AS n, sum(count(*)) OVER () / (count(*) OVER ())::DOUBLE AS e FROM cohort GROUP BY med_group))"""),
    "chisq_drug_sex": (("people",), _independence(_cells("sex", ("F", "M")))),
    "chisq_drug_age": (("people",), _independence(_cells("age_band", AGES))),
    "persistence_times": (("times",), """SELECT nhc, med_code, med_group, med_name, national_code, dispensed_at, qty, freq_desc,
  posology_days, valid_from, valid_to, sex, months, is_last FROM times"""),
    "persistence_counts": (("counts",), "SELECT * FROM counts"),
    "frequent_drugs": (("ranked",), "SELECT * FROM ranked"),
    "km_curve": (("km",), f"SELECT * REPLACE ({rnd('survival', 6)} AS survival) FROM km"),
    "km_median": (("km",), f"""SELECT med_group, {rnd('(CASE WHEN next_at > half_at THEN (half_at + next_at) / 2 ELSE half_at END)', 6)} AS median_months FROM (
  SELECT med_group, min(months) FILTER (WHERE survival <= 0.5 + 1.5e-8) AS half_at, min(months) FILTER (WHERE survival < 0.5 - 1.5e-8) AS next_at
  FROM km GROUP BY med_group)"""),
    "logrank_observed_expected": (("oe",), f"SELECT * REPLACE ({rnd('expected', 6)} AS expected) FROM oe"),
    "logrank_test": (("oe", "cov"), _LOGRANK),
    "km_curve_all": (("allkm",), f"SELECT * REPLACE ({rnd('survival', 6)} AS survival) FROM allkm"),
    "km_median_all": (("allkm",), f"""SELECT med_group, {rnd('(CASE WHEN next_at > half_at THEN (half_at + next_at) / 2 ELSE half_at END)', 6)} AS median_months FROM (
  SELECT med_group, min(months) FILTER (WHERE survival <= 0.5 + 1.5e-8) AS half_at, min(months) FILTER (WHERE survival < 0.5 - 1.5e-8) AS next_at
  FROM allkm GROUP BY med_group)"""),
    "logrank_all_observed_expected": (("alloe",), f"SELECT * REPLACE ({rnd('expected', 6)} AS expected) FROM alloe"),
    "logrank_covariance_all": (("allcov",), f"SELECT comparison, p, q, {rnd('covariance', 6)} AS covariance FROM allcov WHERE p <= q"),
    "logrank_all": (("alloe", "allcov"), _LOGRANK_ALL),
    "multi_drug_patients": (("fine",), """SELECT nhc, med_group, med_name, dispensed_at, qty, tie2, tie3, tie4, tie5 FROM fine
  WHERE nhc IN (SELECT nhc FROM fine GROUP BY nhc HAVING count(DISTINCT coalesce(med_group, '?')) > 1)"""),
    "treatment_lines": (("lines",), "SELECT * FROM lines"),
    "paths_wide": (("paths", "lines"), """SELECT l.nhc, p.path, l.position, l.med_group, l.months
  FROM lines l JOIN paths p USING (nhc)"""),
    "path_frequency": (("freq",), "SELECT * FROM freq"),
    "path_duration_stats": (("vectors", "freq"), f"""SELECT path, n, CAST(i AS INT) AS position, drug AS med_group,
  floor(sum(x) / CAST(count(*) AS DOUBLE) + 0.5) / 10 AS mean_months, {rnd('(sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) / nullif(CAST(count(*) * (count(*) - 1) AS DOUBLE), 0)) / 10.0)', 1)} AS sd_months,
  min(x) / 10.0 AS min_months, max(x) / 10.0 AS max_months FROM (
   SELECT path, i, drugs[i] AS drug, CAST(round(durations[i] * 10) AS BIGINT) AS x
   FROM vectors, LATERAL (SELECT unnest(range(1, len(drugs) + 1)) AS i) g) JOIN freq USING (path) GROUP BY ALL"""),
    "top_paths": (("freq",), "SELECT * FROM freq ORDER BY n DESC, path LIMIT 20"),
    "line_position_frequency": (("lines",), """SELECT d.med_group, CAST(p.position AS INT) AS position, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT med_group FROM lines) d CROSS JOIN (SELECT DISTINCT position FROM lines) p
  LEFT JOIN (SELECT med_group, position, count(*) AS n FROM lines GROUP BY ALL) c USING (med_group, position)"""),
    "line_flows": (("paths", "freq"), """SELECT drugs[1] AS first_drug, drugs[2] AS second_drug, count(*) AS n FROM paths
  WHERE path IN (SELECT path FROM freq ORDER BY n DESC, path LIMIT 20) GROUP BY ALL"""),
    "dose_optimised": (("disp", "presc", "dosed"), f"""SELECT d.nhc, d.med_code, d.med_name, d.dispensed_at, d.qty, p.dose, p.freq_code,
  p.freq_desc, coalesce(p.prescriptions, 0) AS prescriptions, f.naive, f.dose_optimised FROM disp d
  LEFT JOIN (SELECT nhc, med_code, presc_nhc_raw, dose, freq_code, freq_desc, count(*) AS prescriptions FROM presc GROUP BY ALL) p
   ON d.nhc = p.nhc AND d.med_code = p.med_code
  JOIN (SELECT DISTINCT presc_nhc_raw, med_code, naive, dose_optimised FROM dosed) f
   ON f.presc_nhc_raw IS NOT DISTINCT FROM p.presc_nhc_raw AND f.med_code = d.med_code
  WHERE d.med_group = '{DOSE_DRUG}'"""),
    "dose_variants": (("variants",), "SELECT * FROM variants"),
    "dose_variants_wide": (("pervariant",), """SELECT nhc, combination, CAST(g.i AS INT) AS position, v[g.i] AS variant
  FROM pervariant, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) g"""),
    "dose_combinations": (("pervariant",), "SELECT combination, count(*) AS patients FROM pervariant GROUP BY ALL"),
}


#: Hexadecimal digits as a number in this engine.
HEX_NUMBER = "('0x' || {})"

# Report tables and the query whose rows they hold.
REPORT_ROWS = {
    ("outcome", "summary"): "outcome_report", ("outcome", "chart"): "outcome_long",
    ("outcome", "steps"): "baseline_difference",
    ("trend", "fit"): "trend_fit", ("trend", "coefficients"): "trend_coefficients", ("trend", "correlation"): "trend_correlation",
    ("trend", "points"): "activity_points", ("trend", "band"): "trend_band", ("trend", "crossings"): "threshold_crossing",
    ("quality", "start_in_remission"): "qc_start_in_remission",
    ("quality", "unmatched_dispensings"): "unmatched_dispensings",
    ("quality", "prescriptions"): "qc_prescriptions", ("quality", "overlaps"): "qc_overlaps",
    ("adherence", "summary"): "coverage_summary", ("adherence", "patients"): "patients_total",
    ("adherence", "by_drug"): "coverage_summary_by_drug", ("adherence", "chart"): "coverage_by_group",
    ("adherence", "detail"): "coverage_detail", ("adherence", "chart_by_drug"): "coverage_drug_totals",
    ("persistence", "patients"): "naive_patients_total", ("paths", "patients"): "paths_wide",
    ("persistence", "by_drug"): "cohort_by_drug", ("persistence", "by_drug_sex"): "cohort_by_drug_sex",
    ("persistence", "by_drug_age"): "cohort_by_drug_age", ("persistence", "chisq_drug"): "chisq_drug",
    ("persistence", "chisq_sex"): "chisq_drug_sex", ("persistence", "chisq_age"): "chisq_drug_age",
    ("persistence", "curves"): "km_curve", ("persistence", "medians"): "km_median",
    ("persistence", "logrank"): "logrank_test", ("persistence", "all_logrank"): "logrank_all",
    ("persistence", "all_curves"): "km_curve_all", ("persistence", "all_medians"): "km_median_all",
    ("paths", "top_20"): "top_paths", ("paths", "flows"): "line_flows",
    ("paths", "all_paths"): "path_duration_stats", ("paths", "lines"): "treatment_lines",
    ("dosing", "combinations"): "dose_combinations",
    ("dosing", "optimised_patients"): "dose_variants_wide", ("dosing", "all_patients"): "dose_optimised",
}


def with_tables(needed: tuple[str, ...], select: str) -> str:
    """The select with its intermediate tables, each after those it needs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in TABLES[name][0]:
                add(other)
            ordered.append(name)

    for name in needed:
        add(name)
    tables = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in ordered)
    return f"WITH {tables}\n{select}"


def _report_counts() -> str:
    needed: list[str] = []
    parts = []
    for (report, table), query in REPORT_ROWS.items():
        tables, select = SELECTS[query]
        needed += tables
        parts.append(f"SELECT '{report}' AS report, '{table}' AS table_name, count(*) AS n_rows, {fingerprint(report, table, HEX_NUMBER)} AS fingerprint FROM ({select})")
    return with_tables(tuple(needed), "\nUNION ALL ".join(parts))


def oracle_sql() -> dict[str, str]:
    texts = {name: with_tables(needed, select) for name, (needed, select) in SELECTS.items()}
    texts["report_sinks"] = _report_counts()
    return texts
