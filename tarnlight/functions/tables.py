"""Table functions: rows out of one value, and rows out of a partition of a table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Register html_links(html) and running_targets(table) for SQL."""

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.links: list[list] = []
            self.open = False

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "a" and (href := dict(attrs).get("href")) is not None:
                self.links.append([href, ""])
                self.open = True

        def handle_endtag(self, tag: str) -> None:
            self.open = self.open and tag != "a"

        def handle_data(self, data: str) -> None:
            if self.open:
                self.links[-1][1] += data

    class HtmlLinks:
        """place, href, label of each anchor with an href, in order; a null has none."""

        def eval(self, html: str) -> Iterator[tuple]:
            parser = Anchors()
            parser.feed(html or "")
            parser.close()
            for place, (href, label) in enumerate(parser.links):
                yield place, href, label

    class RunningTargets:
        """For each row of a partition, in order: its page, and how many pages before it in the partition have the same href. One number is held, however large the partition."""

        def __init__(self):
            self.n = 0
            self.last = None

        def eval(self, row) -> Iterator[tuple]:
            if row["page_id"] != self.last:
                yield row["href"], row["page_id"], self.n
                self.n += 1
                self.last = row["page_id"]

    spark.udtf.register("html_links", udtf(HtmlLinks, returnType="place int, href string, label string"))
    spark.udtf.register("running_targets", udtf(RunningTargets, returnType="href string, page_id bigint, n_before bigint"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, label for every link of pages(page_id, html) (a lateral join with a table function)."""
    register(pages.sparkSession)
    return pages.sparkSession.sql("select page_id, l.place, l.href, l.label from {pages}, lateral html_links(html) as l", pages=pages)


def link_order(links: DataFrame) -> DataFrame:
    """href, page_id, n_before: the pages that have each href, numbered by page_id (a table function over partitions in order)."""
    register(links.sparkSession)
    rows = links.select("href", "page_id")
    rows.createOrReplaceTempView("tarnlight_links")  # table arguments are named
    return links.sparkSession.sql("select * from running_targets(table(tarnlight_links) partition by href order by page_id)")
