"""Fixed values.

Category texts, cut points and text patterns that results have to equal. They
are data, listed in their natural order.
"""

# Yes / no flags
YES = "Si"
NO = "No"

# Activity bands of the score, from high to low
ACTIVITY_HIGH = "Activitat alta"
ACTIVITY_MODERATE = "Activitat moderada"
ACTIVITY_LOW = "Activitat baixa"
REMISSION = "Remissió"
ACTIVITY_LEVELS = (ACTIVITY_HIGH, ACTIVITY_MODERATE, ACTIVITY_LOW, REMISSION)
SCORE_REMISSION = 2.6
SCORE_LOW = 3.2
SCORE_MODERATE = 5.1
SCORE_LIMIT = 10.0

# Result of a treatment process
NO_FOLLOW_UP = "Sense seguiment"
SUCCESS = "Èxit"
NO_CHANGE = "Sense canvis"
FAILURE = "Fracàs"
# The superseded first-to-minimum rule spells success differently
SUCCESS_BY_SPAN = "Exit"

# Regression thresholds and the bands written next to them
TREND_THRESHOLDS = (2.5, 3.1)
TREND_POINTS = (2.5, 3.1, 5.0)
TREND_LOW = "Activ.Baixa"

# Coverage classes in display order
COVERAGE_SINGLE = "Consum únic"
COVERAGE_LEVELS = ("<0.5", "0.5-0.8", "0.8-0.9", ">=0.9")

# Age bands in display order
AGE_LEVELS = ("Menors de 20 anys", "20-40 anys", "41-50 anys", "51-60 anys",
              "61-70 anys", "71-80 anys", ">80 anys", "Edat no disponible")

# Row label of totals
TOTALS = "Totals"

# Identifier that stands for "not available"
INVALID_IDS = ("N/D",)
