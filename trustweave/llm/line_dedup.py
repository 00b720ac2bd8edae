"""Line dedup by site-relative frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, aside, back, maybe_broadcast

#: Share of a host's pages above which a line is boilerplate, and the pages it must stand on more than: what stands on
#: one page only is repeated nowhere, and would be all of a host that has but a few.
RATIO, FLOOR = 0.1, 1
#: Text of a page: scripts, styles and comments go, other tags end a line.
DROP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null for null, empty where there is none."""
    return F.lower(F.regexp_extract(url, "://([^/?#]+)", 1))


def page_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, DROP, " "), "<[^>]*>", "\n")


def line_list(text: Column) -> Column:
    """Trimmed lines with something in them, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, floor: int = FLOOR, copies: bool = True) -> DataFrame:
    """(hkey, host_pages, bad): for each host its pages and the hashes of lines that stand on more than ratio of them
    and on more than floor.

    pages: rows (hkey, lines). A page counts once however often it repeats a line. The lines of a host are counted
    before they are shuffled, and no host can have more boilerplate lines than its mean lines a page / ratio.
    Without copies, pages of a host with the same lines in the same order are one page.
    """
    pages = pages.select("hkey", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"))
    if not copies:
        pages = Written(pages.sparkSession, "distinct").put(pages.distinct(), "pages")
    totals = pages.groupBy("hkey").agg(F.count(F.lit(1)).alias("host_pages"))
    each = pages.select("hkey", F.explode(F.array_distinct("hs")).alias("h"))
    counts = each.groupBy("hkey", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > floor)
    bad = counts.join(maybe_broadcast(totals), "hkey").filter(F.col("n") > F.lit(ratio) * F.col("host_pages"))
    bad = bad.groupBy("hkey").agg(F.sort_array(F.collect_list("h")).alias("bad"))
    return totals.join(bad, "hkey", "left")


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, floor: int = FLOOR, copies: bool = True) -> DataFrame:
    """pages with host_pages, n_lines, n_dropped (long) and kept_text added; all its rows and columns stay.

    A line is boilerplate if it stands on more than ratio of its host's pages and on more than floor pages.
    Null or empty text: no lines, kept_text empty. Null host: the pages without one form a host. A page that
    repeats a line counts once for it and loses all its copies; repeated rows are pages of their own, but
    without copies texts of a host with the same lines count as one page. A text of which every line goes is empty, its
    row stays. Added names overwrite columns of the same name.
    """
    rows, names = aside(pages)
    site = F.col(names[host])
    rows = rows.withColumns({"hkey": F.when(site.isNull(), "N").otherwise(F.concat(F.lit("S"), site)), "lines": line_list(F.col(names[text]))})
    found = Written(pages.sparkSession, "lines").put(boilerplate(rows.select("hkey", "lines"), ratio, floor, copies), "hosts")
    rows = rows.join(maybe_broadcast(found.withColumn("bad", F.coalesce("bad", F.array().cast("array<bigint>")))), "hkey", "left")
    rows = rows.withColumn("kept", F.expr("CASE WHEN size(bad) = 0 THEN lines ELSE filter(lines, x -> NOT array_contains(bad, xxhash64(x))) END"))
    added = {"n_lines": F.size("lines").cast("long"), "n_dropped": (F.size("lines") - F.size("kept")).cast("long"), "kept_text": F.array_join("kept", "\n")}
    return back(rows.withColumns(added), names, ["host_pages", *added])


def op4(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    return drop_boilerplate(pages, "host", "text").select("page_id", "host", "host_pages", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
       list_filter(list_transform(string_split(coalesce(regexp_replace(regexp_replace(html,
         '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', chr(10), 'g'), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
x AS (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p),
b AS (SELECT x.host, x.line FROM x JOIN t ON x.host IS NOT DISTINCT FROM t.host GROUP BY x.host, x.line, host_pages
      HAVING count(*) > 1 AND count(*) > 0.1::DOUBLE * host_pages),
a AS (SELECT host, list(line) AS bad FROM b GROUP BY host)
SELECT page_id, p.host, host_pages, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(lines, lambda y: list_contains(coalesce(bad, []), y))) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(list_filter(lines, lambda y: NOT list_contains(coalesce(bad, []), y)), chr(10)), '')) AS kept_sha256
FROM p JOIN t ON p.host IS NOT DISTINCT FROM t.host LEFT JOIN a ON p.host IS NOT DISTINCT FROM a.host
"""
