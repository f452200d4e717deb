"""Checks of a service's responses, and reports from small tables of results."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of an error object.
ERROR_KEYS = ("code", "details", "message", "request_id")


def well_formed_error(body: Column, code: str, request_id: Column, retry_after: Column) -> Column:
    """Whether a JSON body has an error object of exactly the four keys, this code and id, and Retry-After is whole seconds from 1 on."""
    error = F.get_json_object(body, "$.error")
    keys = F.array_sort(F.json_object_keys(error))
    shape = keys == F.array(*[F.lit(k) for k in ERROR_KEYS])
    same = (F.get_json_object(error, "$.code") == code) & F.get_json_object(error, "$.request_id").eqNullSafe(request_id)
    return F.coalesce(shape & same & retry_after.rlike(r"^\p{Nd}+$") & ~retry_after.rlike("^0+$"), F.lit(False))


def header_findings(answers: DataFrame, stranger: str, private: Sequence[str] = (), key: str = "id") -> DataFrame:
    """(key, check, seen): what a response gives away, a row per failed check.

    answers has path, status, origin (the request's) and the headers server, allow_origin, content_type and content_options.
    docs-open: a private path is answered with 200; json-sniffable: JSON may be taken for another type; origin-open: any site,
    or the stranger that asked, may read the answer; server-version: the server names its version. A null header is absent.
    """
    column = F.col
    checks = {
        "docs-open": (column("path").isin(*private) & (column("status") == 200), column("path")),
        "json-sniffable": (column("content_type").startswith("application/json") & ~F.lower("content_options").eqNullSafe("nosniff"), column("content_type")),
        "origin-open": ((column("allow_origin") == "*") | (column("origin") == stranger) & column("allow_origin").isNotNull(), column("allow_origin")),
        "server-version": (column("server").rlike(r"\p{Nd}"), column("server")),
    }
    failed = F.array(*[F.when(bad, F.struct(F.lit(name).alias("check"), seen.alias("seen"))) for name, (bad, seen) in checks.items()])
    return answers.select(key, F.inline(F.filter(failed, lambda x: x.isNotNull())))


def markdown(rows: DataFrame, digits: Mapping[str, int] | None = None, most: int = 1000) -> str:
    """A table of a small result: its rows in their order, numbers with so many digits. More than `most` rows are an error."""
    digits, found = digits or {}, rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report's table has at most {most} rows")

    def cell(name: str, v) -> str:
        text = "" if v is None else f"{v:.{digits.get(name, 4)}f}" if isinstance(v, float) else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = [rows.columns, ["---"] * len(rows.columns), *[[cell(n, r[n]) for n in rows.columns] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def write_report(rows: DataFrame, title: str, path: str, **kw) -> None:
    """A Markdown file of one table, written through Spark, so that the path may be in any store."""
    text = f"# {title}\n\n{markdown(rows, **kw)}"
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def credential(name: str, hint: str, environment: Mapping[str, str] | None = None) -> str:
    """The value of an environment variable; without it the program ends with the hint."""
    value = (os.environ if environment is None else environment).get(name, "")
    if not value:
        raise SystemExit(f"{name} is not set. {hint}")
    return value


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two tables side by side by a row number that both have."""
    return left.join(right, key)
