"""Search strings compiled to filters and semi-joins.

Column clauses follow three-valued logic: a null is neither found nor, by the negated clause, left over. Phrases and child clauses
are true or false of every row.

Groups are parted by ``|`` or `` OR ``; a group's clauses all hold. A clause is a word or quoted phrase, looked up as the
start of a phrase in the text columns, or ``field:value`` with ``=`` (exact), ``""`` (empty), ``a-b`` (range),
``>``, ``>=``, ``<``, ``<=``, or else contains. A leading ``-`` negates. A filter on a child table's field asks for a
matching child row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.text import tokens

_CLAUSE = re.compile(r'\s*(?:(?P<or>\||OR(?=\s))|(?P<neg>-)?(?:(?P<field>\w+):)?(?P<value>=?"[^"]*"|[^\s|]+))')
_NUMBER = r"\d+(?:\.\d+)?"


class SearchError(ValueError):
    """The search string can't be read."""

    def __init__(self, query: str, message: str):
        super().__init__(f"{message}: {query!r}")
        self.query = query


@dataclass(frozen=True)
class Clause:
    op: str
    value: str = ""
    end: str = ""
    field: str | None = None
    negated: bool = False


@dataclass
class Catalog:
    """What a search sees: fields by name, text columns for phrases, children as (table, key, value column)."""

    key: str
    fields: dict[str, str]
    text: list[str]
    children: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    #: Text columns for fields that aren't known; phrases are looked up in ``text``, which may hold the key too.
    loose: list[str] | None = None


def parse(query: str) -> list[list[Clause]]:
    if query.count('"') % 2:
        raise SearchError(query, "a quote isn't closed")
    groups: list[list[Clause]] = [[]]
    at, query_end = 0, len(query.rstrip())
    while at < query_end:
        m = _CLAUSE.match(query, at)
        if not m:
            raise SearchError(query, f"can't read from position {at}")
        at = m.end()
        if m["or"]:
            groups.append([])
        else:
            groups[-1].append(clause(m["field"], m["value"], bool(m["neg"])))
    if any(not g for g in groups) and len(groups) > 1:
        raise SearchError(query, "a group is empty")
    return [g for g in groups if g]


def clause(name: str | None, value: str, negated: bool) -> Clause:
    if name is None:
        return Clause("phrase", value.strip('"'), negated=negated)
    if value.startswith("="):
        return Clause("exact", value[1:].strip('"'), "", name, negated)
    if value == '""':
        return Clause("empty", "", "", name, negated)
    if m := re.fullmatch(rf"({_NUMBER})-({_NUMBER})", value):
        return Clause("range", m[1], m[2], name, negated)
    if m := re.fullmatch(r"(>=|<=|>|<)(.+)", value):
        return Clause(m[1], m[2].strip('"'), "", name, negated)
    return Clause("contains", value.strip('"'), "", name, negated)


def like(c: Column, value: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` of the value are live."""
    return F.lower(c.cast("string")).like("%" + value.lower().replace("\\", "\\\\") + "%")


def compare(c: Column, kind: str, op: str, value: str) -> Column:
    number = re.fullmatch(rf"-?{_NUMBER}", value)
    right = F.lit(float(value)) if number and kind not in ("string",) else F.lit(value)
    left = c if kind != "string" or not number else c.try_cast("double")
    right = F.lit(float(value)) if number else right
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def phrase(cat: Catalog, value: str) -> Column:
    wanted = re.findall(r"[^\W_]+", fold(value))
    if not wanted:
        return F.lit(False)
    lead = F.lit(" " + " ".join(wanted))
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(c).cast("string")), " ")), lead), F.lit(False)) for c in cat.text])


def fold(value: str) -> str:
    return value.lower().translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))


def condition(df: DataFrame, cat: Catalog, c: Clause) -> Column:
    if c.op == "phrase":
        out = phrase(cat, c.value)
    else:
        name = cat.aliases.get(c.field, c.field)
        if name not in cat.fields:
            out = reduce(lambda a, b: a | b, [like(F.col(x), c.value) for x in cat.loose or cat.text])
        else:
            col, kind = F.col(cat.fields[name]), dict(df.dtypes)[cat.fields[name]]
            if c.op == "exact":
                out = F.lower(col.cast("string")) == c.value.lower()
            elif c.op == "empty":
                out = col.isNull() | (col == "") if kind == "string" else col.isNull()
            elif c.op == "range":
                out = compare(col, kind, ">=", c.value) & compare(col, kind, "<=", c.end)
            elif c.op == "contains":
                out = like(col, c.value)
            else:
                out = compare(col, kind, c.op, c.value)
    return ~out if c.negated else out


def child_keys(cat: Catalog, c: Clause) -> DataFrame:
    child, key, value = cat.children[c.field]
    rows = child
    if c.op == "exact":
        rows = child.filter(F.lower(F.col(value).cast("string")) == c.value.lower())
    elif c.op != "empty":
        rows = child.filter(like(F.col(value), c.value))
    return rows.select(F.col(key).alias(cat.key)).distinct()


def search(df: DataFrame, cat: Catalog, query: str) -> DataFrame:
    """The rows that the search string finds; an empty one finds all.

    Column clauses become one filter, which reaches the scan. In a string of one group a clause on a child table is a semi-join, negated an anti-join; else it joins a flag
    column made of the distinct matching keys, so that it may stand in any group.
    """
    groups = parse(query)
    if not groups:
        return df
    if len(groups) == 1:
        own = [condition(df, cat, c) for c in groups[0] if c.field not in cat.children]
        out = df.filter(reduce(lambda a, b: a & b, own)) if own else df
        for c in (c for c in groups[0] if c.field in cat.children):
            out = out.join(child_keys(cat, c), cat.key, "left_anti" if c.negated != (c.op == "empty") else "left_semi")
        return out
    out, conditions, flags = df, [], []
    for group in groups:
        parts = []
        for c in group:
            if c.field in cat.children:
                flag = f"_child{len(flags)}"
                flags.append(flag)
                out = out.join(child_keys(cat, c).withColumn(flag, F.lit(True)), cat.key, "left")
                hit = F.col(flag).isNotNull()
                parts.append(~hit if c.negated != (c.op == "empty") else hit)
            else:
                parts.append(condition(df, cat, c))
        conditions.append(reduce(lambda a, b: a & b, parts))
    return out.filter(reduce(lambda a, b: a | b, conditions)).drop(*flags)


def ordered(df: DataFrame, by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Sorted by one column, ``-`` for descending: text by lower case, nulls last when ascending, first when descending."""
    name = by.lstrip("-")
    key = F.lower(name) if dict(df.dtypes)[name] == "string" else F.col(name)
    return df.orderBy(key.desc_nulls_first() if by.startswith("-") else key.asc_nulls_last(), *then)


def default_order(found: DataFrame, query: str, artist: str, title: str) -> DataFrame:
    """Hits of a search string by artist and title, bytes compared and nulls first; without a clause the rows stay as they come."""
    return found.orderBy(F.col(artist).asc_nulls_first(), F.col(title).asc_nulls_first()) if parse(query) else found


def chosen_columns(found: DataFrame, names: str, known: dict[str, str]) -> DataFrame:
    """The columns of a comma-separated list, in its order; ``known`` gives what each name stands for, and another name is an error that tells the known ones."""
    wanted = [n.strip() for n in names.split(",")]
    odd = [n for n in wanted if n not in known]
    if odd:
        raise SearchError(names, f"unknown column {odd[0]}; available: {', '.join(known)}")
    return found.select(*[F.col(known[n]).alias(n) for n in dict.fromkeys(wanted)])


def json_rows(found: DataFrame, fields: dict[str, str], key: str, children: DataFrame, child: str, name: str) -> DataFrame:
    """``json``: each hit as an object of the given fields, null ones too, with its sorted child values as an array; the rows are the array's elements."""
    lists = children.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(child)).alias("_list"))
    rows = found.join(lists, F.col(key) == F.col("_key"), "left")
    values = [F.col(c).alias(n) for n, c in fields.items()] + [F.coalesce("_list", F.array().cast("array<string>")).alias(name)]
    return rows.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("json"))
