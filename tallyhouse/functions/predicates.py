"""Field conditions as filter columns.

The result is meant for `DataFrame.where`: a comparison that is NULL drops the
row there, which leaves plain comparisons that the Parquet scan can take over.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.paths import _col
from tallyhouse.functions.scalars import bytes_in

_CLAUSE = re.compile(
    r"""\s*(?P<field>[^\s<>=!'"]+)\s*
        (?P<op>>=|<=|!=|=|>|<|(?<=\s)like(?=[\s'"]))\s*
        (?P<value>'[^']*'|"[^"]*"|(?!and\b).+?)\s*
        (?:\s(?P<more>and)(?:\s|$)|$)""",
    re.IGNORECASE | re.VERBOSE | re.DOTALL,
)


def like(value: Column | str, pattern: str) -> Column:
    """Anchored LIKE where `%` and `_` are the only special characters."""
    return _col(value).like(pattern.replace("\\", "\\\\"))


def glob(value: Column | str, pattern: str) -> Column:
    """LIKE with `*` for `%` and `?` for `_`."""
    return like(value, pattern.replace("*", "%").replace("?", "_"))


def conditions(text: str) -> list[tuple[str, str, object]]:
    """`size > 1GB AND ext = 'log'` as (field, operator, value) triples."""
    found, at = [], 0
    while text[at:].strip():
        clause = _CLAUSE.match(text, at)
        if not clause:
            raise ValueError(f"not a condition: {text[at:]!r}")
        found.append((clause["field"], clause["op"].upper(), _value(clause["value"])))
        if clause["more"] and not text[clause.end() :].strip():
            raise ValueError(f"condition missing after {text!r}")
        at = clause.end()
    return found


def _value(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    size = bytes_in(text)
    if size is not None:
        return size
    if re.fullmatch(r"[+-]?[0-9][0-9.]*\s*[KMGT]?I?B", text, re.IGNORECASE):
        raise ValueError(f"not a size: {text!r} (whole numbers only)")
    return float(text) if re.fullmatch(r"[+-]?[0-9]+\.[0-9]+", text) else text


def condition(df: DataFrame, field: str, op: str, value) -> Column:
    """One comparison; a missing, NULL or wrong-typed field satisfies only `!=`."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wanted = T.StringType if isinstance(value, str) else T.NumericType
    if not isinstance(kinds.get(field), wanted):
        return F.lit(op == "!=")
    field_col, literal = F.col(f"`{field}`"), F.lit(value)
    if op == "!=":
        return (field_col != literal) | field_col.isNull()
    if op == "=":
        return field_col == literal
    if op == "LIKE":
        return like(field_col, value) if isinstance(value, str) else F.lit(False)
    if isinstance(value, str):
        return F.lit(False)
    return {
        ">": field_col > literal,
        "<": field_col < literal,
        ">=": field_col >= literal,
        "<=": field_col <= literal,
    }[op]


def _member(field: str) -> str:
    quote = "'" if '"' in field else '"'
    if quote in field:
        raise ValueError(f"a field name with both kinds of quotes: {field}")
    return f"$[{quote}{field}{quote}]"


def untyped_condition(record: Column | str, field: str, op: str, value) -> Column:
    """One comparison with a field of a VARIANT, never NULL.

    The type is that of the field in this very record: a record without it, one where it
    has another type than `value` and one that is no object satisfy only `!=`.
    """
    record, member = _col(record), _member(field)
    kind = F.schema_of_variant(F.try_variant_get(record, member, "variant"))

    def compared(of_kind, target):
        found = F.when(kind.rlike(of_kind), F.try_variant_get(record, member, target))
        return {"=": found == value, "!=": found != value, ">": found > value, "<": found < value, ">=": found >= value, "<=": found <= value}[op]

    if isinstance(value, str):
        if op == "LIKE":
            return F.coalesce(F.when(kind == "STRING", like(F.try_variant_get(record, member, "string"), value)), F.lit(False))
        meets = compared("^STRING$", "string") if op in ("=", "!=") else F.lit(False)
    elif op == "LIKE":
        return F.lit(False)
    else:
        # whole numbers keep all digits
        meets = F.coalesce(compared("^BIGINT$", "bigint"), compared("^(DECIMAL|DOUBLE|FLOAT)", "double"))
    return F.coalesce(meets, F.lit(op == "!="))


def all_of_untyped(record: Column | str, where) -> Column:
    """The conjunction of `where`, given as triples or as text, on the fields of a VARIANT."""
    triples = conditions(where) if isinstance(where, str) else where
    keep = F.lit(True)
    for field, op, value in triples:
        keep = keep & untyped_condition(record, field, op, value)
    return keep


def all_of(df: DataFrame, where) -> Column:
    """The conjunction of `where`, given as triples or as text."""
    triples = conditions(where) if isinstance(where, str) else where
    keep = F.lit(True)
    for field, op, value in triples:
        keep = keep & condition(df, field, op, value)
    return keep
