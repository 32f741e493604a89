"""The static function surface of semantic expressions, and what Spark calls it."""

from __future__ import annotations

#: Permitted functions by category.
FUNCTIONS = {
    "aggregate": ["AVG", "COUNT", "MAX", "MIN", "SUM"],
    "conditional": ["COALESCE", "NULLIF"],
    "conversion": ["CAST", "TO_CHAR", "TO_DATE"],
    "date": ["DATE_TRUNC", "DAY", "EXTRACT", "MONTH", "TRUNC", "YEAR"],
    "numeric": ["ABS", "CEIL", "FLOOR", "ROUND"],
    "string": ["CONCAT", "LOWER", "LPAD", "LTRIM", "REPLACE", "RTRIM", "SUBSTR", "TRIM", "UPPER"],
}
#: Reachable only on the right-hand side of a predicate.
RHS_FUNCTIONS = ["ADD_MONTHS", "CURRENT_DATE", "CURRENT_TIMESTAMP"]
ALLOWED = frozenset(f for names in FUNCTIONS.values() for f in names)
AGGREGATES = frozenset(FUNCTIONS["aggregate"])
MERGEABLE = frozenset(["SUM", "COUNT"])

#: Date format elements and Spark's pattern letters, longest first.
DATE_ELEMENTS = [("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("MON", "MMM"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss")]
#: Units of TRUNC for dates, and Spark's names.
TRUNC_UNITS = {"YYYY": "YEAR", "YY": "YEAR", "YEAR": "YEAR", "Q": "QUARTER", "QUARTER": "QUARTER", "MM": "MONTH", "MON": "MONTH", "MONTH": "MONTH", "WW": "WEEK", "IW": "WEEK", "WEEK": "WEEK"}

_FAMILIES = {
    "numeric": ("DECIMAL", "NUMBER", "NUMERIC", "DEC", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "REAL", "LONG", "SHORT", "BYTE"),
    "string": ("CHAR", "VARCHAR", "VARCHAR2", "NVARCHAR", "CLOB", "STRING"),
    "temporal": ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"),
    "interval": ("INTERVAL",),
    "boolean": ("BOOLEAN", "BOOL"),
}


def type_family(name: str | None) -> str | None:
    """Family of a declared or physical type name: numeric, string, temporal, interval, boolean or other."""
    if not name:
        return None
    head = name.strip().upper().replace("(", " ").split()[0]
    return next((f for f, names in _FAMILIES.items() if head in names), "other")


def date_pattern(fmt: str) -> str:
    """A date format such as YYYY-MM-DD as a Spark pattern."""
    out, at = "", 0
    while at < len(fmt):
        for element, letters in DATE_ELEMENTS:
            if fmt[at : at + len(element)].upper() == element:
                out, at = out + letters, at + len(element)
                break
        else:
            out, at = out + fmt[at], at + 1
    return out


def spark_type(name: str) -> str:
    """A declared type as a type that Spark can cast to."""
    family, head = type_family(name), name.strip().upper().split("(")[0].split()[0]
    args = name[name.index("(") :] if "(" in name else ""
    if family == "string":
        return "STRING"
    if head in ("NUMBER", "NUMERIC", "DEC", "DECIMAL"):
        return f"DECIMAL{args or '(18,0)'}"
    if head == "INTEGER":
        return "INT"
    if head == "REAL":
        return "FLOAT"
    if head == "TIMESTAMP":
        return "TIMESTAMP_NTZ"
    return name
