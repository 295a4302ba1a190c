"""Parts of addresses by pattern; total functions, so that odd addresses give results too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import BINARY, SECTIONS


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def domain_of(url: Column) -> Column:
    """Host without ``www.``; the address itself if it has none."""
    host = F.lower(host_of(url))
    return F.when(host == "", url).otherwise(F.regexp_replace(host, r"^www\.", ""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def section_of(url: Column) -> Column:
    path = F.lower(path_of(url))
    found = F.lit("Pages")
    for name, pattern in reversed(SECTIONS):
        found = F.when(path.rlike(pattern), name).otherwise(found)
    return found


def _encoded(path: Column) -> Column:
    """Characters beyond ASCII, and blanks, as browsers send them."""
    return F.when(
        path.rlike("[^\\x21-\\x7e]"),
        F.array_join(
            F.transform(
                F.split(path, ""),
                lambda x: F.when(x.rlike("[^\\x21-\\x7e]"), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x),
            ),
            "",
        ),
    ).otherwise(path)


def _walked(path: Column) -> Column:
    """The path without ``.`` and ``..`` parts."""
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    up = lambda held: F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda held, p: F.when(p == "..", up(held)).when(p == ".", held).otherwise(F.concat(held, F.array(p))),
    )
    ends = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(
        path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, ends).otherwise("")),
    ).otherwise(path)


def resolved(rows: DataFrame, href: Column, page: Column, to: str) -> DataFrame:
    """The rows with ``to``, the absolute form of an http(s) target as seen from a page, without fragment or, unless the path is only
    that, a slash at the end; other schemes stay as they are. Each step has a projection of its own, so nothing is computed twice."""
    step = "_resolved"
    target = F.regexp_replace(F.trim(href), "#.*$", "")
    rows = rows.withColumn(
        step,
        F.struct(
            target.alias("target"), F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("origin"),
            path_of(page).alias("path"), F.regexp_replace(page, "#.*$", "").alias("page"),
        ),
    )
    of = lambda name: F.col(f"{step}.{name}")
    whole = (
        F.when(of("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), of("target"))
        .when(of("target").startswith("//"), F.concat(F.regexp_extract(of("origin"), "^[^:]*:", 0), of("target")))
        .when(of("target").startswith("/"), F.concat(of("origin"), of("target")))
        .when(of("target").startswith("?"), F.concat(of("origin"), of("path"), of("target")))
        .when(of("target") == "", of("page"))
        .otherwise(F.concat(of("origin"), F.regexp_replace(of("path"), "[^/]*$", ""), of("target")))
    )
    rows = rows.withColumn(step, whole)
    rows = rows.withColumn(
        step,
        F.struct(
            F.col(step).alias("whole"), F.lower(F.regexp_extract(step, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)).alias("origin"),
            path_of(F.col(step)).alias("path"), F.regexp_extract(step, r"(\?.*)$", 1).alias("query"),
        ),
    )
    rows = rows.withColumn(
        step,
        F.struct(of("whole").alias("whole"), of("origin").alias("origin"), _walked(of("path")).alias("path"), of("query").alias("query")),
    )
    found = F.concat(of("origin"), _encoded(of("path")), _encoded(of("query")))
    rows = rows.withColumn(step, F.struct(of("whole").alias("whole"), (of("path") == "/").alias("root"), found.alias("found")))
    bare = F.when(of("root"), of("found")).otherwise(F.regexp_replace(of("found"), "/$", ""))
    # behind a generator, or conditions on the result would be moved below with all of its steps inside
    return rows.select(
        "*", F.explode(F.array(F.when(of("whole").rlike("(?i)^https?://"), bare).otherwise(of("whole")))).alias(to),
    ).drop(step)


def slug_of(path: Column) -> Column:
    """A file name of a path: without slashes at its ends, with dashes for those inside, without an ending; ``index`` for the root."""
    bare = F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"), F.lit("-"))
    return F.regexp_replace(F.when(bare == "", "index").otherwise(bare), r"\.[^.]+$", "")


def with_https(url: Column) -> Column:
    """The address with https, whatever it came with."""
    return F.when(url.startswith("http://"), F.concat(F.lit("https://"), F.substr(url, F.lit(8)))).when(
        url.startswith("https://"), url,
    ).otherwise(F.concat(F.lit("https://"), url))


def is_binary(url: Column) -> Column:
    """Whether an address names a file that a crawl leaves out."""
    return url.rlike(BINARY)
