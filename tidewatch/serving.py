"""Results as a service: named tables, kept as Parquet, and the requests that are asked of them, answered as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.analysis import page
from tidewatch.session import listing
from tidewatch.sources.sinks import as_json

MOST_ROWS = 10_000  # of an answer; a page, a list or one store's rows are far below


def save(found: Mapping[str, DataFrame], path: str) -> None:
    """Write results, each a table below path; what is there under the same names is replaced."""
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Results as `save` wrote them, by name."""
    names = sorted({x.split("/", 1)[0] for x in listing(spark, path) if "/" in x})
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def rows_of(df: DataFrame) -> list[dict]:
    """The rows as dictionaries; ValueError if there are more than MOST_ROWS, as an answer isn't an export."""
    found = as_json(df.limit(MOST_ROWS + 1)).collect()  # at most MOST_ROWS + 1
    if len(found) > MOST_ROWS:
        raise ValueError(f"an answer of more than {MOST_ROWS} rows; ask for a page, or export the table")
    return [json.loads(r.json) for r in found]


class Service:
    """Requests over results of `analysis.analyze` and of the queries, by name; tables that aren't there give empty answers."""

    def __init__(self, found: Mapping[str, DataFrame]):
        self.found = dict(found)
        self.requests: dict[str, Callable[..., object]] = {
            f.__name__: f for f in (self.stores, self.servers, self.summary, self.fed_groups, self.store_details, self.anomalous_stores, self.recommendations, self.forecast, self.machine_health)
        }

    def call(self, name: str, **arguments) -> str:
        """The answer to a request, as JSON; KeyError for an unknown one."""
        return json.dumps(self.requests[name](**arguments))

    def _table(self, name: str) -> DataFrame | None:
        return self.found.get(name)

    def _rows(self, name: str) -> list[dict]:
        df = self._table(name)
        return [] if df is None else rows_of(df)

    def stores(self, page_number: int = 1, size: int = 50, by: str = "disconnects", ascending: bool = False, **filters) -> dict:
        """A page of stores with the number of them and of pages; filters as of analysis.page (server, fed_group, least, store)."""
        df = self._table("stores")
        if df is None:
            return {"data": [], "total": 0, "page": page_number, "size": size, "pages": 0}
        total = page(df, by=by, size=None, **filters).count()
        data = rows_of(page(df, page_number, size, by, ascending=ascending, **filters))
        return {"data": data, "total": total, "page": page_number, "size": size, "pages": -(-total // size)}

    def servers(self) -> list[dict]:
        """Totals by server, and of all."""
        return self._rows("servers")

    def fed_groups(self) -> list[dict]:
        """Stores and disconnects by role group."""
        return self._rows("fed_groups")

    def summary(self) -> dict:
        """Stores, disconnects and the longest outage over all servers."""
        df = self._table("stores")
        if df is None:
            return {"stores": 0, "disconnects": 0, "longest_s": None}
        one = df.agg(
            F.countDistinct("store_id").alias("stores"),
            F.coalesce(F.sum("disconnects"), F.lit(0)).alias("disconnects"),
            F.max("longest_s").alias("longest_s"),
        )
        return one.first().asDict()

    def store_details(self, store_id: str) -> dict:
        """One store's rows of all tables with a store_id; empty for a store that isn't known."""
        store = store_id.zfill(5)
        tables = {name: df for name, df in self.found.items() if "store_id" in df.columns}
        return {name: rows for name, df in tables.items() if (rows := rows_of(df.where(F.col("store_id") == store)))}

    def anomalous_stores(self, limit: int = 20) -> list[dict]:
        """Stores with label -1, the most votes first."""
        df = self._table("anomalies")
        if df is None:
            return []
        order = [F.desc(c) for c in ("confidence", "votes") if c in df.columns]
        return rows_of(df.where("label = -1").orderBy(*order, "store_id").limit(limit))

    def recommendations(self, priority: int | None = None) -> list[dict]:
        """Recommendations, the most urgent and certain first; of one priority, if given."""
        df = self._table("recommendations")
        if df is None:
            return []
        rows = df if priority is None else df.where(F.col("priority") == priority)
        return rows_of(rows.orderBy("priority", F.desc_nulls_last("confidence")))

    def forecast(self) -> list[dict]:
        """The next hours."""
        return self._rows("forecast")

    def machine_health(self) -> list[dict]:
        """Machines with their score and band, the worst first."""
        df = self._table("machine_health")
        return [] if df is None else rows_of(df.orderBy("score", "machine"))
