"""Names and lists the analyses share."""

# Study constants that results depend on.
EXCLUDED_PROVIDERS = ("Greater Manchester Police", "Police Service of Northern Ireland")
EXCLUDED_LABELS = "Manchester|Bolton|Oldham|Rochdale|Stockport|Tameside|Salford|Bury|Trafford|Wigan"
EXCLUDED_PREFIX = "9"
KEPT_PREFIXES = ("E", "W")
NON_NOTIFIABLE = ("Anti-social behaviour", "Drugs")
TOTAL_CATEGORY = "Notifiable offences (excl. drugs)"
LONG_RUN_CATEGORIES = ("Public order", "Violence and sexual offences", "Other crime")
CITIES = {
    "Birmingham": "Birmingham",
    "Leeds": "Leeds",
    "Sheffield": "Sheffield",
    "Bradford": "Bradford",
    "Liverpool": "Liverpool",
    "Cardiff": "Cardiff",
}
DETACHED_AREA = "W01001940"

STUDY_MONTHS = ("02", "03", "04", "05", "06", "07", "08")
MONTH_NAMES = ("february", "march", "april", "may", "june", "july", "august")
MONTH_STEPS = ("feb_mar", "mar_apr", "apr_may", "may_jun", "jun_jul", "jul_aug")


def study_periods(year: str) -> list[str]:
    return [f"{year}-{m}" for m in STUDY_MONTHS]
