"""Where the rows of a data object come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import SemanticError
from ..model import DataObject

Tables = Callable[[DataObject], DataFrame]


def folder(spark: SparkSession, path: str, form: str = "parquet", **options) -> Tables:
    """Files ``<path>/<code>.<form>`` of any format that Spark reads."""
    known: dict[str, DataFrame] = {}

    def get(o: DataObject) -> DataFrame:
        code = o.code or o.name
        if code not in known:
            known[code] = spark.read.format(form).options(**options).load(f"{path}/{code}.{form}")
        return known[code]

    return get


def catalog(spark: SparkSession) -> Tables:
    """Tables of the session's catalogs, qualified by schema, or database and schema, where the object names them."""
    return lambda o: spark.table(".".join(f"`{p}`" for p in (o.database, o.schema, o.code or o.name) if p))


def frames(by_code: dict[str, DataFrame]) -> Tables:
    """Frames at hand, by the objects' codes."""

    def get(o: DataObject) -> DataFrame:
        if (o.code or o.name) not in by_code:
            raise SemanticError("UNBOUND_OBJECT", f"no frame is given for {o.name} ({o.code})")
        return by_code[o.code or o.name]

    return get


def jdbc(spark: SparkSession, url: str, ranges: dict[str, tuple[str, object, object, int]] | None = None, **options) -> Tables:
    """Tables of an external database, qualified as the object is.

    ``ranges`` says by code how a large table is read in parallel: (column, least, most, number of tasks).  Others come
    through one connection.
    """

    def get(o: DataObject) -> DataFrame:
        name = ".".join(p for p in (o.database, o.schema, o.code or o.name) if p)
        own = zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, (ranges or {}).get(o.code or o.name, ())))
        return spark.read.format("jdbc").options(url=url, dbtable=name, **{**options, **dict(own)}).load()

    return get
