"""DuckDB SQL that states the results a second time.

RE2 patterns may use ``\\b``, which is ASCII there, but have no look-around. Here every
rule numbers its placeholders at once, in rule order over the whole scan, while the
Spark side works with tokens; the two meet only in the result.
"""

from __future__ import annotations

from ..functions.text import WS

S = f"[{WS}]"
SD = f"[{WS}-]"
SDD = f"[{WS}.-]"
LABEL_SEP = f"[{WS}:–-]"
RUN = f"[A-Za-z0-9{WS},.-]"

# The patterns once more, for RE2.
CARD = rf"\b(?:\d{{4}}{SD}+){{3}}\d{{4}}\b|\b(?:\d{{4}}{SD}?){{3}}\d{{4}}\b|\b\d{{16}}\b"
AADHAAR = rf"\b[2-9]\d{{3}}{SD}+\d{{4}}{SD}+\d{{4}}\b|\b[2-9]\d{{11}}\b"
PHONE = (
    rf"(?:\+44{SDD}*(?:\d{SDD}*){{9,10}}\b)"
    rf"|\b(?:\+91{SDD}*|0{SDD}*)?[6-9]\d{{4}}{SDD}+\d{{5}}\b"
    rf"|\b(?:\+91{SDD}*|0{SDD}*)?[6-9]\d{{2}}{SDD}+\d{{3}}{SDD}+\d{{4}}\b"
    rf"|\b(?:\+91{SDD}*|0{SDD}*)?[6-9]\d{{9}}\b"
    rf"|(?:\+1{SDD}*)?\(?\d{{3}}\)?{SDD}*\d{{3}}{SDD}+\d{{4}}\b"
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
_WORDS = rf"[A-Z][a-z]+(?:{S}+[A-Z][a-z]+){{1,2}}\b"
NAME = (
    rf"(\b(?:name|applicant|customer|account{S}+holder){LABEL_SEP}+){_WORDS}"
    rf"|\b(?:Mr\.|Mrs\.|Ms\.|Dr\.){S}+{_WORDS}"
)
_PLACE = (
    "Street|St|Avenue|Ave|Road|Rd|Block|Sector|Park|Nagar|Lane|Drive|Dr|Floor|Apt|Suite|"
    "Building|Delhi|Mumbai|Bangalore|Bengaluru|Kolkata|Chennai|Hyderabad|Pune|India"
)
ADDRESS = (
    rf"(?i)(\b(?:address|residence){LABEL_SEP}+?){RUN}+\b(?:{_PLACE}|USA|UK)\b{RUN}*"
    rf"|\b\d{{1,5}}{S}+{RUN}+(?:{_PLACE})\b{RUN}*"
)
PATTERNS = {
    "card": CARD, "aadhaar": AADHAAR, "phone": PHONE, "email": EMAIL, "pan": PAN,
    "name": NAME, "address": ADDRESS,
}
PREFIX = {
    "card": "CARD", "aadhaar": "AADHAAR", "phone": "PHONE", "email": "EMAIL", "pan": "PAN",
    "name": "PERSON", "address": "ADDRESS",
}
LABELLED = ("name", "address")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{S}+|{S}+$')}, '', 'g')"


def collapse_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit(S + '+')}, ' ', 'g')"


def luhn_sql(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT)"
    total = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 "
        f"THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END))"
    )
    return f"(length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def key_sql(category: str, x: str) -> str:
    x = strip_sql(x)
    if category == "email":
        return f"lower({x})"
    if category in ("phone", "card", "payment", "aadhaar"):
        return f"regexp_replace({x}, {lit(SDD)}, '', 'g')"
    if category == "pan":
        return f"upper({x})"
    return collapse_sql(x)


def valid_sql(category: str, x: str) -> str:
    return luhn_sql(x) if category == "card" else "TRUE"


def matches_sql(category: str, text: str) -> str:
    """List of struct(label, raw): every candidate of one rule in ``text``."""
    pattern = lit(PATTERNS[category])
    whole = f"regexp_extract_all({text}, {pattern})"
    if category not in LABELLED:
        return f"list_transform({whole}, lambda w: {{'label': '', 'raw': w}})"
    labels = f"regexp_extract_all({text}, {pattern}, 1)"
    return (
        f"list_transform(list_zip({whole}, {labels}), lambda w: {{'label': coalesce(w[2], ''), "
        f"'raw': substr(w[1], length(coalesce(w[2], '')) + 1)}})"
    )


def blank_sql(x: str) -> str:
    return f"(NOT coalesce(regexp_matches({x}, {lit(f'[^{WS}]')}), FALSE))"


def placeholder_sql(x: str) -> str:
    return (
        f"(regexp_full_match({x}, '(?i)(EMAIL|PHONE|PERSON|CARD|ADDRESS|PASSWORD|PAN|AADHAAR)_[0-9]+')"
        f" OR contains({x}, '[REDACTED:'))"
    )


PERSON_VALUE = rf"^[A-Z][a-z]+(?:{S}+[A-Z][a-z]+){{1,3}}$"


def fold_sql(source: str, keep: list[str], fields: bool = False) -> tuple[str, str]:
    """CTEs that fold the seven rules over ``texts`` (a list per scan, in order).

    Returns (ctes, last name). Every stage carries ``k_<category>``, the keys found in
    each text, and ``dk_<category>``, the distinct keys of the scan in order.

    With ``fields``, the source also has lists as long as ``texts``: ``card_purge``
    (an extra CARD key or NULL), ``name_field`` and ``address_field`` (booleans).
    """
    cols = ", ".join(keep + (["card_purge", "name_field", "address_field", "orig"] if fields else []))
    ctes, prev = [], source
    done: list[str] = []
    for category, prefix in PREFIX.items():
        p = f"f_{category}"
        carried = "".join(f", {c}" for c in done)
        pattern = lit(PATTERNS[category])
        extra = fields and {"card": "card", "name": "name", "address": "address"}.get(category)

        def redone(number: str, t: str, m: str) -> str:
            key = key_sql(category, "y[2].raw")
            return (
                f"array_to_string(list_transform(list_zip(string_split_regex({t}, {pattern}), {m}), "
                f"lambda y: y[1] || CASE WHEN y[2] IS NULL THEN '' "
                f"WHEN {valid_sql(category, 'y[2].raw')} THEN y[2].label || '{prefix}_' || "
                f"{number.format(key=key)} ELSE y[2].label || y[2].raw END), '')"
            )

        ctes.append(
            f"{p}_m AS MATERIALIZED (SELECT {cols}{carried}, texts, list_transform(texts, lambda t: "
            f"{matches_sql(category, 't')}) AS m FROM {prev})"
        )
        found = (
            f"list_transform(list_filter(coalesce(m[i], []), lambda h: {valid_sql(category, 'h.raw')}), "
            f"lambda h: {key_sql(category, 'h.raw')})"
        )
        if extra == "card":
            more = "CASE WHEN card_purge[i] IS NOT NULL THEN [card_purge[i]] ELSE [] END"
        elif extra == "name":
            more = (
                f"CASE WHEN name_field[i] AND t = orig[i] AND len(m[i]) = 0 "
                f"AND NOT regexp_matches(t, {lit(ADDRESS)}) AND NOT {placeholder_sql('t')} "
                f"AND regexp_matches({strip_sql('t')}, {lit(PERSON_VALUE)}) "
                f"THEN [{key_sql('name', 't')}] ELSE [] END"
            )
        elif extra == "address":
            marked = redone("{key}", "t", "m[i]")
            whole = (
                f"CASE WHEN len(m[i]) > 0 THEN t = m[i][1].raw ELSE {placeholder_sql('t')} END"
            )
            more = (
                f"CASE WHEN address_field[i] AND NOT {blank_sql('t')} AND NOT {whole} "
                f"THEN [{key_sql('address', marked)}] ELSE [] END"
            )
        else:
            more = "[]"
        ctes.append(
            f"{p}_e AS MATERIALIZED (SELECT *, list_transform(texts, lambda t, i: {more}) AS ex, "
            f"list_transform(texts, lambda t, i: {found}) AS ms FROM {p}_m)"
            if extra else
            f"{p}_e AS MATERIALIZED (SELECT *, list_transform(texts, lambda t, i: {found}) AS ms FROM {p}_m)"
        )
        keys = "list_transform(ms, lambda x, i: x || ex[i])" if extra else "ms"
        ctes.append(
            f"{p}_k AS MATERIALIZED (SELECT *, {keys} AS ks, flatten({keys}) AS flat FROM {p}_e)"
        )
        ctes.append(
            f"{p}_d AS MATERIALIZED (SELECT *, list_filter(flat, lambda x, i: list_position(flat, x) = i) AS dk "
            f"FROM {p}_k)"
        )
        normal = (
            f"CASE WHEN len(ms[i]) = 0 THEN t ELSE "
            f"{redone('CAST(list_position(dk, {key}) AS VARCHAR)', 't', 'm[i]')} END"
        )
        if extra in ("name", "address"):
            normal = (
                f"CASE WHEN len(ex[i]) > 0 THEN '{prefix}_' || CAST(list_position(dk, ex[i][1]) AS VARCHAR) "
                f"ELSE {normal} END"
            )
        ctes.append(
            f"{p} AS MATERIALIZED (SELECT {cols}{carried}, CASE WHEN len(flat) = 0 THEN texts ELSE "
            f"list_transform(texts, lambda t, i: {normal}) END AS texts, "
            f"ks AS k_{category}, dk AS dk_{category} FROM {p}_d)"
        )
        done += [f"k_{category}", f"dk_{category}"]
        prev = p
    return ", ".join(ctes), prev
