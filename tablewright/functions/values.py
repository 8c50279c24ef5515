"""Word lists, patterns and orders that results depend on."""

# Placeholders that stand for a missing value (compared trimmed and in lower case).
NULL_TOKENS = (
    "", "na", "n/a", "n.a.", "nan", "none", "null", "nil", "nu11", "-", "--", "---", "?", "??",
    "unknown", "unspecified", "missing", "not available", "not applicable", "no data", "blank",
    "#n/a", "#na", "#null!", "#div/0!", "(blank)", ".", "void", "tbd", "todo", "-999", "-9999",
)
# Words for true and false.
TRUE_TOKENS = ("true", "t", "yes", "y", "1", "1.0", "on", "enabled")
FALSE_TOKENS = ("false", "f", "no", "n", "0", "0.0", "off", "disabled")
# Fixed value: currency symbols.
CURRENCY = "$€£¥₹₽¢"
# Name parts of identifiers and contact data.
IDENTIFIER_PARTS = frozenset(("id", "uuid", "guid", "key", "code", "email", "phone", "mobile", "fax", "username", "account", "zip", "zipcode", "postcode", "pin"))
KEY_WORDS = frozenset(("id", "uuid", "guid", "key", "code", "no", "number", "email", "username"))
# Name parts of quantities that can't be negative, and of percentages.
NON_NEGATIVE = (
    "age", "price", "amount", "cost", "qty", "quantity", "count", "salary", "income", "weight", "height",
    "duration", "distance", "balance", "revenue", "total", "score", "stock",
)
PERCENT_PARTS = ("percent", "pct", "rate", "ratio", "share")
# Fixed value: text that looks like a date.
DATE_HINT = r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\s+\w{3,9}\s+\d{2,4}|\d{4}-\d{2}-\d{2}T"
# Letters that a wrong decoding leaves.
MOJIBAKE = ("Ã", "â€", "Â", "ï»¿", "�", "Ð", "Ñ")
# Patterns of personal data, in order of priority.
PII = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "phone": r"^\+?[\d(][\d\s().-]{7,17}\d$",
    "credit_card": r"^(?:\d[ -]?){13,19}$",
    "ip_address": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "aadhaar": r"^\d{4}\s?\d{4}\s?\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
}
# Severities, risks and the order of actions in a plan.
SEVERITY = ("critical", "high", "medium", "low", "info")
RISKS = ("low", "medium", "high")
DATE_ORDERS = {"dmy": True, "mdy": False}
ORDER = {
    "drop_columns": 10, "drop_empty_rows": 12, "replace_sentinels_with_na": 20, "fix_encoding": 22, "strip_whitespace": 25, "normalize_case": 27,
    "unify_categories": 30, "group_rare_categories": 32, "cast_numeric": 40, "cast_datetime": 42, "cast_boolean": 44, "coerce_consistent_type": 46,
    "enforce_range": 55, "enforce_date_range": 56, "handle_outliers": 60, "fill_missing": 70, "drop_high_missing_columns": 72, "mask_pii": 80,
    "drop_duplicate_rows": 90, "drop_near_duplicate_rows": 92, "cast_category": 94, "standardize_column_names": 96, "rename_columns": 97, "none": 99,
}
#: Duplicates go earlier than that when they are planned.
PLANNED_ORDER = {"drop_duplicate_rows": 65, "drop_near_duplicate_rows": 67}
RISK = {
    "drop_columns": "high", "drop_duplicate_rows": "high", "drop_near_duplicate_rows": "high", "drop_high_missing_columns": "high", "mask_pii": "high",
    "fill_missing": "high", "handle_outliers": "high", "drop_empty_rows": "medium", "cast_numeric": "medium", "cast_datetime": "medium",
    "enforce_range": "medium", "enforce_date_range": "medium", "coerce_consistent_type": "medium",
}
# Formats of dates, month first.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M/d/yy", "d/M/yy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyyMMdd",
    "M.d.yyyy", "d.M.yyyy", "M-d-yyyy", "d-M-yyyy",
)
#: More forms that a cast to dates takes; a time of day may follow any form.
MORE_DATE_FORMATS = ("MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d-MMM-yyyy", "d-MMM-yy", "d MMM, yyyy", "d MMMM, yyyy", "yyyy.M.d")
TIMES = "['T'][ ][h:mm[:ss] a][H:mm[:ss]]"
# Letters and digits of Unicode 14 and 15 (code points in hexadecimal), which the regular expressions of Java 17 don't know.
NEWER_LETTERS = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 "
    "10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 "
    "107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 "
    "12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 "
    "1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee "
    "1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
# Letters of Unicode 16 that only Spark's mappings of case know: capitals and small ones.
NEWEST_UPPER = "\u1c89\ua7cb\ua7cc\ua7da\ua7dc" + "".join(map(chr, range(0x10D50, 0x10D66)))
NEWEST_LOWER = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
