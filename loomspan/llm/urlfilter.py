"""URL filters by a temporal join with dated lists, in DataFrame operations only.

A list is a log of dated entries: a pattern (host in lower case) was added to or removed from a
block or allow list. Each pattern's entries become validity intervals; every
capture is joined as of its fetch time with the intervals of the patterns that
its URL could match: its host, every parent domain, and every leading part of
its path. The most specific active entry decides, and allow wins a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, clash_free

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def patterns(url: Column, depth: int) -> Column:
    """Patterns of up to ``depth`` path segments that could match a URL: ``host/a/b``, shorter paths, the host, and ``.domain`` for it and each parent."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    steps = F.slice(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), 1, depth)
    paths = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps)), lambda k: k > 0), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), k), "/")))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("."), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    return F.when(host != "", F.array_distinct(F.concat(paths, F.array(host), parents))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)`` of ``entries(list, pattern, action, at)``.

    An ``add`` holds from its time until the pattern's next entry on that
    list (null: still). Of entries with one time a removal counts last. Rows
    with a null are left out.
    """
    good = entries.select("list", "pattern", "action", "at").dropna().distinct()
    order = Window.partitionBy("list", "pattern").orderBy("at", "action")
    return good.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add'").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to").where("valid_to IS NULL OR valid_from < valid_to")


def decide(captures: DataFrame, entries: DataFrame, id_column: str = "page_id", url_column: str = "url", time_column: str = "fetched", salts: int = 16) -> DataFrame:
    """One row per capture: ``id_column``, ``decision`` (block, allow or none), ``pattern``, ``listed_from``.

    The longest active pattern decides (a path beats its host, a host its
    domains), allow before block, then the earlier entry.

    * a null or odd URL, or a null time, matches nothing: decision none;
    * repeated captures stay and are decided alike; repeated entries count once;
    * other columns of either table are ignored; an empty list blocks nothing.

    A list of proven small size is broadcast; otherwise captures are salted and
    the list is repeated for each salt, so that one host can't fill a task.
    """
    stage = Stage(captures.sparkSession, "urls")
    active = stage.put(intervals(clash_free(entries, list="list", pattern="pattern", action="action", at="at")), "intervals")
    depth = active.agg(F.max(F.regexp_count("pattern", F.lit("/")))).first()[0] or 0  # of the deepest entry
    asked = clash_free(captures, id=id_column, url=url_column, at=time_column).withColumn("row", F.monotonically_increasing_id())
    asked = stage.put(asked.select("row", "id", "at", patterns(F.col("url"), depth).alias("patterns")), "asked")
    tried = asked.select("row", "at", F.explode("patterns").alias("pattern"))
    holds = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    if stage.size("intervals") <= 32 << 20:
        hits = tried.join(F.broadcast(active), "pattern").where(holds)
    else:
        salted = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = tried.withColumn("salt", F.pmod("row", F.lit(salts)).cast("int")).join(salted.hint("merge"), ["pattern", "salt"]).where(holds)
    key = F.struct(F.when(F.col("pattern").startswith("."), 1).otherwise(0).alias("wide"), (-F.char_length("pattern")).alias("short"), F.col("list").alias("list"), F.col("valid_from"), F.col("pattern"))
    best = hits.groupBy("row").agg(F.min(key).alias("best"))
    out = asked.select("row", "id").join(best.hint("merge"), "row", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("best.list", F.lit("none")).alias("decision"), F.col("best.pattern").alias("pattern"), F.col("best.valid_from").alias("listed_from"))
